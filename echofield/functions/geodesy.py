"""WGS-84 coordinates. Angles are in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Vec

# The WGS-84 ellipsoid, the speed of light and the earth's rate.
SEMI_MAJOR = 6378137.0
SEMI_MINOR = 6356752.314245179
ECCENTRICITY_2 = 6.6943799901377997e-3
LIGHT = 299792458.0
EARTH_RATE = 7.292115e-5


def to_ecf(lat: Column, lon: Column, height: Column) -> Vec:
    phi, lam = F.radians(lat), F.radians(lon)
    radius = SEMI_MAJOR / F.sqrt(1 - ECCENTRICITY_2 * F.sin(phi) * F.sin(phi))
    across = (radius + height) * F.cos(phi)
    return Vec(across * F.cos(lam), across * F.sin(lam), (radius * (1 - ECCENTRICITY_2) + height) * F.sin(phi))


def with_geodetic(df: DataFrame, point: str, names: tuple[str, str, str] = ("lat", "lon", "height")) -> DataFrame:
    """Adds latitude, longitude and height of point_x, point_y, point_z.

    Closed form: the quartic for the point's foot on the ellipsoid is solved through its
    resolvent cubic. Null inside the evolute. Each step is a column of its own, as later
    ones use it several times.
    """
    e2, e4, a2 = ECCENTRICITY_2, ECCENTRICITY_2**2, SEMI_MAJOR**2
    c = F.col
    x, y, z = c(f"{point}_x"), c(f"{point}_y"), c(f"{point}_z")
    steps = [
        {"_w": F.sqrt(x * x + y * y), "_n": z * z * ((1 - e2) / a2)},
        {"_r": (c("_w") * c("_w") / a2 + c("_n") - e4) / 6, "_s": e4 / 4 / a2 * c("_w") * c("_w") * c("_n")},
        {"_o": c("_s") + 2 * c("_r") * c("_r") * c("_r")},
        {"_g": F.when(c("_o") > 0, F.cbrt(c("_s") + c("_r") * c("_r") * c("_r") + F.sqrt(c("_s") * c("_o"))))},
        {"_t": c("_r") + c("_g") + c("_r") * c("_r") / c("_g")},
        {"_u": F.sqrt(c("_t") * c("_t") + e4 * c("_n"))},
        {"_v": e2 * (c("_t") + c("_u") - c("_n")) / (2 * c("_u"))},
        {"_k": F.sqrt(c("_t") + c("_u") + c("_v") * c("_v")) - c("_v")},
        {"_d": c("_k") * c("_w") / (c("_k") + e2)},
        {"_l": F.sqrt(c("_d") * c("_d") + z * z)},
        {
            names[0]: F.degrees(2 * F.atan2(z, c("_d") + c("_l"))),
            names[1]: F.when(c("_o") > 0, F.degrees(F.atan2(y, x))),
            names[2]: (c("_k") + e2 - 1) / c("_k") * c("_l"),
        },
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.drop("_w", "_n", "_r", "_s", "_o", "_g", "_t", "_u", "_v", "_k", "_d", "_l")


def to_geocentric(p: Vec) -> tuple[Column, Column, Column]:
    """Geocentric latitude, longitude and radius; the origin gives zeros."""
    radius = p.norm()
    lat = F.when(radius > 0, F.degrees(F.asin(p.z / radius))).otherwise(0.0)
    return lat, F.degrees(F.atan2(p.y, p.x)), radius


def normal(p: Vec) -> Vec:
    """Outward unit normal of the ellipsoid through p."""
    return Vec(p.x / SEMI_MAJOR**2, p.y / SEMI_MAJOR**2, p.z / SEMI_MINOR**2).unit()


def north_east_down(lat: Column, lon: Column) -> tuple[Vec, Vec, Vec]:
    """The local axes in earth-fixed coordinates."""
    phi, lam = F.radians(lat), F.radians(lon)
    north = Vec(-F.sin(phi) * F.cos(lam), -F.sin(phi) * F.sin(lam), F.cos(phi))
    east = Vec(-F.sin(lam), F.cos(lam), F.lit(0.0))
    return north, east, Vec(-F.cos(phi) * F.cos(lam), -F.cos(phi) * F.sin(lam), -F.sin(phi))


def to_ned(p: Vec, lat: Column, lon: Column, height: Column, position: bool = True) -> Vec:
    """p in the local frame; vectors that are no positions keep their origin."""
    moved = p - to_ecf(lat, lon, height) if position else p
    north, east, down = north_east_down(lat, lon)
    return Vec(north.dot(moved), east.dot(moved), down.dot(moved))


def from_ned(v: Vec, lat: Column, lon: Column, height: Column, position: bool = True) -> Vec:
    north, east, down = north_east_down(lat, lon)
    out = north * v.x + east * v.y + down * v.z
    return out + to_ecf(lat, lon, height) if position else out


def from_plane(v: Vec, lat: Column, lon: Column, height: Column, azimuth: Column) -> Vec:
    """From a tangent plane whose x axis points to an azimuth clockwise from north, z up."""
    a = F.radians(azimuth)
    return from_ned(Vec(v.x * F.cos(a) + v.y * F.sin(a), v.x * F.sin(a) - v.y * F.cos(a), -v.z), lat, lon, height)


def radial_frame(p: Vec, velocity: Vec, inertial: bool = False) -> tuple[Vec, Vec, Vec]:
    """Radial, in-track and cross-track unit vectors of a platform."""
    if inertial:
        velocity = Vec(velocity.x - EARTH_RATE * p.y, velocity.y + EARTH_RATE * p.x, velocity.z)
    radial = p.unit()
    cross = radial.cross(velocity).unit()
    return radial, cross.cross(radial), cross


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371000.0) -> Column:
    """Haversine distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def parse_angle(text: Column) -> Column:
    """Degrees from delimited or packed degrees, minutes and seconds.

    W, S or a minus sign negate, both together don't. Packed forms are DDD, DDDMM and
    DDDMMSS. What can't be read, or is beyond 360 degrees or 60 minutes, is null.
    """
    upper = F.upper(F.trim(text))
    negative = upper.rlike("[WS]") != upper.startswith("-")
    numbers = F.transform(F.regexp_extract_all(upper, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    packed = F.regexp_extract(upper, r"^[-NSEW ]*(\d{4,7})(\.\d+)?[NSEW ]*$", 1)
    tail = F.regexp_extract(upper, r"^[-NSEW ]*(\d{4,7})(\.\d+)?[NSEW ]*$", 2)
    fraction = F.coalesce(F.when(tail != "", F.concat(F.lit("0"), tail).cast("double")), F.lit(0.0))
    long_ = F.length(packed) >= 6
    head = F.when(long_, F.length(packed) - 4).otherwise(F.length(packed) - 2)
    degrees_ = F.substring(packed, F.lit(1), head).cast("double")
    minutes = F.substring(packed, head + 1, F.lit(2)).cast("double")
    seconds = F.when(long_, F.substring(packed, head + 3, F.lit(2)).cast("double") + fraction).otherwise(0.0)
    minutes = F.when(long_, minutes).otherwise(minutes + fraction)
    d = F.when(packed != "", degrees_).otherwise(F.get(numbers, 0))
    m = F.when(packed != "", minutes).otherwise(F.coalesce(F.get(numbers, 1), F.lit(0.0)))
    s = F.when(packed != "", seconds).otherwise(F.coalesce(F.get(numbers, 2), F.lit(0.0)))
    value = d + m / 60 + s / 3600
    valid = (d <= 360) & (m < 60) & (s < 60) & (F.size(numbers).between(1, 3))
    return F.when(valid, F.when(negative, -value).otherwise(value))


def split_angle(degrees_: Column) -> tuple[Column, Column, Column]:
    """Degrees (with the sign), minutes and seconds."""
    size = F.abs(degrees_)
    whole = F.floor(size)
    minutes = F.floor((size - whole) * 60)
    return F.signum(degrees_) * whole, minutes, ((size - whole) * 60 - minutes) * 60
