"""Collection geometry and projections between image, ground and terrain.

Everything is Column arithmetic on vectors, so it stays within generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import normal, to_ecf, with_geodetic
from ..functions.vectors import Vec


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


ANGLES = ("side", "slant_range", "ground_range", "doppler_cone", "graze", "incidence", "twist", "slope", "azimuth", "layover")


def _between(a: Vec, b: Vec) -> Column:
    """The angle of two vectors (degrees), exact also where they are nearly along each other."""
    return F.degrees(F.atan2(a.cross(b).norm(), a.dot(b)))


def with_angles(df: DataFrame, scp: Vec, arp: Vec, velocity: Vec) -> DataFrame:
    """Adds side, ranges and angles (degrees) at the centre of the aperture."""
    names = ("up", "st", "sn", "gx", "no", "ly")
    up, sight, slant, ground, north, lay = (_vec(x) for x in names)
    own = _kept(_kept(df, "up", normal(scp)), "st", (scp - arp).unit())
    own = own.withColumn("_side", F.signum(arp.cross(velocity).dot(sight)))
    own = _kept(own, "sn", (velocity.cross(sight) * F.col("_side")).unit())
    own = _kept(own, "gx", (sight * -1.0).across(up).unit())
    own = _kept(own, "no", Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)).across(up).unit())
    own = _kept(own, "ly", up - slant * (1 / up.dot(slant)))

    def heading(v: Vec) -> Column:
        return F.pmod(F.degrees(F.atan2(v.dot(north.cross(up)), v.dot(north))) + 360, F.lit(360.0))

    graze = F.degrees(F.asin(_clamped(-up.dot(sight))))
    out = own.withColumns(
        {
            "side": F.when(F.col("_side") < 0, "R").otherwise("L"),
            "slant_range": (scp - arp).norm(),
            "ground_range": scp.norm() * F.acos(_clamped(arp.dot(scp) / (scp.norm() * arp.norm()))),
            "doppler_cone": F.degrees(F.acos(_clamped(velocity.unit().dot(sight)))),
            "graze": graze,
            "incidence": 90 - graze,
            "twist": _between(up.cross(ground), slant) - 90,
            "slope": F.degrees(F.acos(_clamped(up.dot(slant)))),
            "azimuth": heading(ground),
            "layover": heading(lay),
        }
    )
    return out.drop("_side", *[f"{n}_{a}" for n in names for a in "xyz"])


def with_pointing(df: DataFrame, scp: Vec, arp: Vec, velocity: Vec) -> DataFrame:
    """Adds squint, tilt, multipath, track and flight elevation (degrees), side and pass."""
    names = ("up", "pf", "fl", "sl", "gr", "ab")
    own = _kept(_kept(_kept(_kept(df, "up", normal(scp)), "pf", (arp - scp).unit()), "fl", velocity.unit()), "ab", arp.unit())
    up, platform, flight, above = (_vec(x) for x in ("up", "pf", "fl", "ab"))
    own = _kept(_kept(own, "sl", platform.cross(flight).unit()), "gr", platform.across(up).unit())
    own = own.withColumn("_sense", F.signum(_vec("sl").dot(up)))
    own = _kept(own, "sl", _vec("sl") * F.col("_sense"))
    slant, ground = _vec("sl"), _vec("gr")
    own = own.withColumns({"_graze": F.asin(_clamped(platform.dot(up))), "_slope": F.acos(_clamped(slant.dot(up))), "_lay": F.signum(F.asin(_clamped(ground.dot(slant.cross(up).unit()))))})
    own = own.withColumn("_tilt", -F.acos(_clamped(F.cos("_slope") / F.cos("_graze"))) * F.col("_lay"))
    level, aim = velocity.across(above).unit(), (scp - arp).across(above).unit()
    out = own.withColumns(
        {
            "squint": F.degrees(F.atan2(level.cross(aim).dot(above), aim.dot(level))),
            "tilt": F.degrees("_tilt"),
            "multipath": F.degrees(-F.atan(F.tan("_tilt") * F.sin("_graze"))),
            "track": -F.col("_sense") * _between(ground * -1.0, flight.across(up).unit()),
            "flight_elevation": F.degrees(F.asin(_clamped(up.dot(flight)))),
            "right": -F.col("_sense"),
            "ascending": F.signum(velocity.z),
        }
    )
    return out.drop("_sense", "_graze", "_slope", "_lay", "_tilt", *[f"{n}_{a}" for n in names for a in "xyz"])


POINTING = ("squint", "tilt", "multipath", "track", "flight_elevation", "right", "ascending")


# Range and range rate to a surface


def _kept(df: DataFrame, name: str, v: Vec) -> DataFrame:
    """The vector as columns of its own, so that later steps don't repeat it."""
    return df.withColumns({f"{name}_x": v.x, f"{name}_y": v.y, f"{name}_z": v.z})


def _vec(name: str) -> Vec:
    return Vec(F.col(f"{name}_x"), F.col(f"{name}_y"), F.col(f"{name}_z"))


def to_plane(df: DataFrame, name: str, distance: Column, rate: Column, arp: Vec, velocity: Vec, point: Vec, up: Vec) -> DataFrame:
    """Adds name_x.. where a range and a range rate meet a plane; null where they don't."""
    c = F.col
    along, across = _vec("_al"), _vec("_ac")
    own = df.withColumns({"_dist": distance, "_rate": rate, "_high": (arp - point).dot(up), "_climb": velocity.dot(up), "_look": F.signum(up.dot((arp - point).cross(velocity)))})
    own = own.withColumns({"_ground": F.when(c("_high") <= c("_dist"), F.sqrt(F.greatest(F.lit(0.0), c("_dist") * c("_dist") - c("_high") * c("_high")))), "_level": F.sqrt(velocity.dot(velocity) - c("_climb") * c("_climb"))})
    own = _kept(own, "_al", (velocity - up * c("_climb")) * (1 / c("_level")))
    own = _kept(own, "_ac", up.cross(along))
    own = own.withColumn("_cos", (c("_climb") * c("_high") / c("_dist") - c("_rate")) / (c("_level") * c("_ground") / c("_dist")))
    own = own.withColumn("_cos", F.when(F.abs("_cos") <= 1, c("_cos")))
    own = own.withColumn("_sin", c("_look") * F.sqrt(F.greatest(F.lit(0.0), 1 - c("_cos") * c("_cos"))))
    own = _kept(own, name, arp - up * c("_high") + along * (c("_ground") * c("_cos")) + across * (c("_ground") * c("_sin")))
    return own.drop("_dist", "_rate", "_high", "_climb", "_look", "_ground", "_level", "_cos", "_sin", *[f"{n}_{a}" for n in ("_al", "_ac") for a in "xyz"])


def to_height(df: DataFrame, scp: Vec, height: float, steps: int = 3) -> DataFrame:
    """Adds out_x, out_y, out_z: the contour's point at a constant height.

    df has range, rate, arp_*, vel_*. Each step moves a tangent plane to the height; every
    point takes the same number of steps. The last move is along the slant plane's normal.
    """
    own = _kept(_kept(df, "cen", scp), "up", normal(scp))
    own = with_geodetic(own, "cen", ("_lat", "_lon", "_level"))
    own = own.withColumn("_side", F.signum(_vec("up").dot((_vec("arp") - scp).cross(_vec("vel")))))
    own = _kept(own, "ref", scp - _vec("up") * (F.col("_level") - height))
    for _ in range(steps):
        own = to_plane(own, "gp", F.col("range"), F.col("rate"), _vec("arp"), _vec("vel"), _vec("ref"), _vec("up"))
        own = with_geodetic(own, "gp", ("_lat", "_lon", "_over")).withColumn("_over", F.col("_over") - height)
        own = _kept(own, "up", normal(_vec("gp")))
        own = _kept(own, "ref", _vec("gp") - _vec("up") * F.col("_over"))
    own = _kept(own, "sn", (_vec("vel").cross(_vec("gp") - _vec("arp")) * F.col("_side")).unit())
    own = _kept(own, "slp", _vec("gp") - _vec("sn") * (F.col("_over") / _vec("up").dot(_vec("sn"))))
    own = with_geodetic(own, "slp", ("lat", "lon", "_level"))
    own = _kept(own, "out", to_ecf(F.col("lat"), F.col("lon"), F.lit(height)))
    drop = [f"{n}_{a}" for n in ("cen", "up", "ref", "gp", "sn", "slp") for a in "xyz"] + ["_lat", "_lon", "_level", "_over", "_side"]
    return own.drop(*drop)


@dataclass(frozen=True)
class PlaneGrid:
    """A uniformly spaced image plane with a straight flight: time of each pixel is one.

    Vectors are (x, y, z) in metres, earth-fixed.
    """

    scp: tuple[float, float, float]
    row: tuple[float, float, float]
    col: tuple[float, float, float]
    row_spacing: float
    col_spacing: float
    scp_row: int
    scp_col: int
    arp: tuple[float, float, float]
    velocity: tuple[float, float, float]

    @staticmethod
    def vector(v: tuple[float, float, float]) -> Vec:
        return Vec(*[F.lit(float(x)) for x in v])

    def contour(self, r: Column, c: Column) -> tuple[Column, Column]:
        """Range and range rate of pixels (counted from 0)."""
        x, y = (r - self.scp_row) * self.row_spacing, (c - self.scp_col) * self.col_spacing
        point = self.vector(self.scp) + self.vector(self.row) * x + self.vector(self.col) * y
        back = self.vector(self.arp) - point
        distance = back.norm()
        return distance, self.vector(self.velocity).dot(back) / distance

    def with_contour(self, px: DataFrame) -> DataFrame:
        distance, rate = self.contour(F.col("r").cast("double"), F.col("c").cast("double"))
        out = px.withColumn("range", distance).withColumn("rate", rate)
        return _kept(_kept(out, "arp", self.vector(self.arp)), "vel", self.vector(self.velocity))


def image_to_plane(px: DataFrame, grid: PlaneGrid) -> DataFrame:
    """Adds out_* on the plane that touches the ellipsoid's offset at the scene centre."""
    scp = grid.vector(grid.scp)
    own = grid.with_contour(px)
    return to_plane(own, "out", F.col("range"), F.col("rate"), _vec("arp"), _vec("vel"), scp, normal(scp))


def image_to_height(px: DataFrame, grid: PlaneGrid, height: float, steps: int = 3) -> DataFrame:
    return to_height(grid.with_contour(px), grid.vector(grid.scp), height, steps)


def scene_to_image(points: DataFrame, grid: PlaneGrid, steps: int = 5, tolerance: float | None = None) -> DataFrame:
    """Adds row, col of points (x, y, z).

    A point is projected to the image plane, back to the ground, and moved by what it
    misses; a point within a quarter of a pixel's diagonal moves no more.
    """
    most = tolerance if tolerance is not None else 0.25 * (grid.row_spacing**2 + grid.col_spacing**2) ** 0.5
    scp, row, col = grid.vector(grid.scp), grid.vector(grid.row), grid.vector(grid.col)
    plane = row.cross(col).unit()
    arp, velocity = grid.vector(grid.arp), grid.vector(grid.velocity)
    look = F.signum(arp.cross(velocity).dot(scp - arp))
    along = (velocity.cross(scp - arp) * look).unit()
    cos_theta = row.dot(col)
    point = Vec(F.col("x"), F.col("y"), F.col("z"))
    own = _kept(_kept(points, "g", point), "pup", normal(point)).withColumn("_done", F.lit(False)).withColumns({"row": F.lit(None).cast("double"), "col": F.lit(None).cast("double")})
    scale = along.dot(plane)
    for _ in range(steps):
        g = _vec("g")
        moved = g + along * ((scp - g).dot(plane) / scale) - scp
        u, v = moved.dot(row), moved.dot(col)
        s2 = 1 - cos_theta * cos_theta
        r = (u - cos_theta * v) / s2 / grid.row_spacing + grid.scp_row
        c = (v - cos_theta * u) / s2 / grid.col_spacing + grid.scp_col
        own = own.withColumns({"row": F.when(F.col("_done"), F.col("row")).otherwise(r), "col": F.when(F.col("_done"), F.col("col")).otherwise(c)})
        distance, rate = grid.contour(F.col("row"), F.col("col"))
        own = to_plane(own, "back", distance, rate, arp, velocity, point, _vec("pup"))
        own = _kept(own, "miss", point - _vec("back"))
        own = own.withColumn("_done", F.col("_done") | (_vec("miss").norm() <= most))
        own = _kept(own, "g", Vec(*[F.when(F.col("_done"), F.col(f"g_{a}")).otherwise(F.col(f"g_{a}") + F.col(f"miss_{a}")) for a in "xyz"]))
    return own.drop("_done", *[f"{n}_{a}" for n in ("g", "pup", "back", "miss") for a in "xyz"])


def corners(n_rows: int, n_cols: int) -> list[tuple[str, int, int]]:
    """Names and pixels of the corners, first row and column first, clockwise."""
    return [("FRFC", 0, 0), ("FRLC", 0, n_cols - 1), ("LRLC", n_rows - 1, n_cols - 1), ("LRFC", n_rows - 1, 0)]


def with_corners(images: DataFrame, n_rows: Column, n_cols: Column) -> DataFrame:
    """A row for each corner of each image: corner, r, c."""
    last = [(name, bool(r), bool(c)) for name, r, c in corners(2, 2)]
    one = [F.struct(F.lit(name).alias("corner"), ((n_rows - 1) * int(r)).cast("long").alias("r"), ((n_cols - 1) * int(c)).cast("long").alias("c")) for name, r, c in last]
    return images.select("*", F.inline(F.array(*one)))


# Elevation grids


def bilinear(points: DataFrame, grid: DataFrame, step: float, value: str = "elev", wrap: bool = False) -> DataFrame:
    """Adds the grid's value at points (lat, lon), or null beyond it.

    grid has (ilat, ilon, value) at lat = ilat * step, lon = ilon * step. Each point meets
    its four neighbours in an equi-join; nothing is compared but what is near.
    """
    lon = F.pmod(F.col("lon"), F.lit(360.0)) if wrap else F.col("lon")
    keyed = points.withColumn("_u", F.col("lat") / step).withColumn("_v", lon / step)
    keyed = keyed.withColumn("_i", F.floor("_u")).withColumn("_j", F.floor("_v"))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    each = keyed.withColumn("_n", F.explode(near))
    each = each.withColumn("ilat", F.col("_i") + F.col("_n.a")).withColumn("ilon", F.pmod(F.col("_j") + F.col("_n.b"), F.lit(round(360 / step))) if wrap else F.col("_j") + F.col("_n.b"))
    du, dv = F.col("_u") - F.col("_i"), F.col("_v") - F.col("_j")
    weight = F.when(F.col("_n.a") == 1, du).otherwise(1 - du) * F.when(F.col("_n.b") == 1, dv).otherwise(1 - dv)
    joined = each.withColumn("_w", weight).join(grid.select("ilat", "ilon", F.col(value).alias("_value")), ["ilat", "ilon"], "left")
    # A neighbour of weight 0 may be missing.
    ok = F.min((F.col("_value").isNotNull() | (F.col("_w") == 0)).cast("int")) == 1
    return joined.groupBy(*points.columns).agg(F.when(ok, F.sum(F.col("_w") * F.col("_value"))).alias(value))
