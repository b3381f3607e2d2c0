"""Queries over the catalog, geometry, metadata and pulses, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, poly
from ..functions.cx import rounded
from ..functions.vectors import Vec, vec
from ..operators import catalog, formation, geometry, metadata
from . import views
from .pixels import dft_columns, dft_sql
from .views import COLLECT, HEIGHT, PULSE, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Catalog


@query(f"with {COLLECT} select collect_id, round(graze, 3) graze from co where graze > 30 and graze < 40")
def graze_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.graze_between(views.collects(spark, sf_dir)).select("collect_id", F.round("graze", 3).alias("graze"))


@query(f"with {COLLECT} select collect_id, pol polarization, side, collector from co")
def catalog_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.projected(views.collects(spark, sf_dir), {"collect_id": ["collect_id"], "polarization": ["tx_rcv", "pol"], "side": ["side"], "collector": ["core_name", "collector"]})


@query(f"with {COLLECT} select a.collect_id a, b.collect_id b from co a join co b on a.collect_id < b.collect_id and abs(a.lat-b.lat) < 0.001 and abs(a.lon-b.lon) < 0.001 and abs(a.graze-b.graze) < 5")
def pair_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.near_pairs(views.collects(spark, sf_dir))


@query(
    "with l as (select user_id platform_id, event_id, epoch_us(ts)::double/1e6 t from events), o as (select user_id platform_id, epoch_us(ts)::double/1e6 t, max(value) \"value\" from events where event_type = 'purchase' group by 1, 2),"
    " j as (select l.platform_id, l.event_id, o.\"value\", row_number() over (partition by l.event_id order by abs(o.t-l.t), o.t) k from l left join o on l.platform_id=o.platform_id)"
    " select platform_id, event_id, round(\"value\", 4) \"value\" from j where k = 1"
)
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event its platform's nearest observation; purchases are the observations."""
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("platform_id"), "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"), "value")
    right = events.where("event_type = 'purchase'").groupBy("platform_id", "t").agg(F.max("value").alias("value"))
    return catalog.nearest_in_time(events.drop("value", "event_type"), right, "platform_id", "t", "value").select("platform_id", "event_id", F.round("value", 4).alias("value"))


@query(f"with {COLLECT}, ra as (select range*10.0::double low, range*10.0::double+15 high from range(-6, 6)) select collect_id, min(low) low from co join ra on lat >= low and lat < high group by 1")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.range(-6, 6).select((F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + 15).alias("high"))
    return catalog.first_within(views.collects(spark, sf_dir).select("collect_id", "lat"), ranges, "", "lat", "low", "high", 10.0).select("collect_id", "low")


@query(
    f"with {COLLECT}, k as (select *, row_number() over (partition by collector, collect_start, lat, lon, pol order by collect_id) k from co)"
    ' select collector::bigint collector, collect_id, min(collect_id) over (partition by collector, collect_start, lat, lon, k) "group" from k'
)
def pol_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the catalog, frames of one collect have equal starts and places."""
    frames = views.collects(spark, sf_dir).select(F.col("collector").cast("long"), "collect_id", "collect_start", "lat", "lon", F.lit(0.0).alias("hae"), "pol", F.lit(64).alias("n_rows"), F.lit(32).alias("n_cols"), F.lit(1.0).alias("spacing"), F.lit(0.5).alias("k_ctr"))
    return catalog.same_collect_groups(frames)


@query(
    f"with {COLLECT} select collect_id, '<Placemark><name>' || collect_id || '</name><Point><coordinates>' || printf('%.4f', lon) || ',' || printf('%.4f', lat) || ',' || printf('%.1f', hae) || '</coordinates></Point></Placemark>' kml from co"
)
def kml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.placemarks(views.collects(spark, sf_dir))


@query(f"with {COLLECT} select collect_id, round((((hour(collect_start)*3600+minute(collect_start)*60+second(collect_start))/3600.0::double+lon/15+24)%24+24)%24, 4) solar_hour from co")
def local_solar_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.collects(spark, sf_dir).select("collect_id", F.round(catalog.local_solar_time(F.col("collect_start"), F.col("lon")), 4).alias("solar_hour"))


# Coordinates

ECF = (
    f"{COLLECT}, ecf as (select *, (n+hae)*cos(radians(lat))*cos(radians(lon)) x, (n+hae)*cos(radians(lat))*sin(radians(lon)) y, (n*(1-{geodesy.ECCENTRICITY_2!r}::double)+hae)*sin(radians(lat)) z"
    f" from (select *, {geodesy.SEMI_MAJOR!r}::double/sqrt(1-{geodesy.ECCENTRICITY_2!r}::double*sin(radians(lat))*sin(radians(lat))) n from co))"
)


def _ecf(spark: SparkSession, sf_dir: str) -> DataFrame:
    co = views.collects(spark, sf_dir)
    p = geodesy.to_ecf(F.col("lat"), F.col("lon"), F.col("hae"))
    return co.withColumns({"p_x": p.x, "p_y": p.y, "p_z": p.z})


@query(f"with {ECF} select collect_id, round(x, 3) + 0.0 x, round(y, 3) + 0.0 y, round(z, 3) + 0.0 z from ecf")
def geodetic_to_ecf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ecf(spark, sf_dir).select("collect_id", *[rounded(F.col(f"p_{a}"), 3).alias(a) for a in "xyz"])


@query(f"with {COLLECT} select collect_id, round(lat, 5) + 0.0 lat, round(case when lon <= -180 then lon + 360 else lon end, 5) + 0.0 lon, round(hae, 3) + 0.0 hae from co")
def ecf_to_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way there and back gives the catalog's own coordinates; the date line is at 180."""
    out = geodesy.with_geodetic(_ecf(spark, sf_dir), "p", ("lat", "lon", "hae"))
    lon = rounded(F.col("lon"), 5)
    return out.select("collect_id", rounded(F.col("lat"), 5).alias("lat"), F.when(lon <= -180, lon + 360).otherwise(lon).alias("lon"), rounded(F.col("hae"), 3).alias("hae"))


@query(f"with {ECF} select collect_id, round(degrees(asin(z/sqrt(x*x+y*y+z*z))), 6) + 0.0 lat, round(sqrt(x*x+y*y+z*z), 3) radius from ecf")
def ecf_to_geocentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, _, radius = geodesy.to_geocentric(vec("p"))
    return _ecf(spark, sf_dir).select("collect_id", rounded(lat).alias("lat"), rounded(radius, 3).alias("radius"))


@query(
    f"with {ECF}, d as (select collect_id, radians(10.0::double) a, radians(20.0::double) b, x-({geodesy.SEMI_MAJOR!r}::double) x, y, z from ecf)"
    " select collect_id, round(-sin(a)*cos(b)*x-sin(a)*sin(b)*y+cos(a)*z, 3) + 0.0 north, round(-sin(b)*x+cos(b)*y, 3) + 0.0 east, round(-cos(a)*cos(b)*x-cos(a)*sin(b)*y-sin(a)*z, 3) + 0.0 down from d"
)
def ecf_to_ned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vec("p")
    v = geodesy.to_ned(Vec(p.x - geodesy.SEMI_MAJOR, p.y, p.z), F.lit(10.0), F.lit(20.0), F.lit(0.0), position=False)
    return _ecf(spark, sf_dir).select("collect_id", rounded(v.x, 3).alias("north"), rounded(v.y, 3).alias("east"), rounded(v.z, 3).alias("down"))


_A2, _B2 = f"({geodesy.SEMI_MAJOR!r}::double*{geodesy.SEMI_MAJOR!r}::double)", f"({geodesy.SEMI_MINOR!r}::double*{geodesy.SEMI_MINOR!r}::double)"


@query(f"with {ECF}, g as (select collect_id, x/{_A2} x, y/{_A2} y, z/{_B2} z from ecf) select collect_id, round(x/sqrt(x*x+y*y+z*z), 8) + 0.0 x, round(y/sqrt(x*x+y*y+z*z), 8) + 0.0 y, round(z/sqrt(x*x+y*y+z*z), 8) + 0.0 z from g")
def ellipsoid_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = geodesy.normal(vec("p"))
    return _ecf(spark, sf_dir).select("collect_id", *[rounded(getattr(n, a), 8).alias(a) for a in "xyz"])


@query(
    f"with {COLLECT}, d as (select collect_id, lat, lon, sin(radians(10.0::double-lat)/2)*sin(radians(10.0::double-lat)/2)+cos(radians(lat))*cos(radians(10.0::double))*sin(radians(20.0::double-lon)/2)*sin(radians(20.0::double-lon)/2) h from co)"
    " select collect_id, round(2*6371000.0::double*asin(sqrt(least(1, h))), 2) metres from d"
)
def ruler_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geodesy.great_circle(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return views.collects(spark, sf_dir).select("collect_id", F.round(d, 2).alias("metres"))


@query(
    f"with {COLLECT}, s as (select collect_id, abs(lat) a, sign(lat) g from co) select collect_id, (g*floor(a))::double + 0.0 deg, floor((a-floor(a))*60)::bigint \"minute\", round(((a-floor(a))*60-floor((a-floor(a))*60))*60, 3) + 0.0 \"second\" from s"
)
def dms_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m, s = geodesy.split_angle(F.col("lat"))
    return views.collects(spark, sf_dir).select("collect_id", (d + F.lit(0.0)).alias("deg"), m.alias("minute"), rounded(s, 3).alias("second"))


@query(
    f"with {COLLECT} select collect_id, round((case when lat < 0 then -1 else 1 end)*((collect_id%90)::double + (collect_id%60)/60.0::double + (collect_id%59)/3600.0::double), 8) + 0.0 \"value\" from co"
)
def dms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("collect_id")
    south = F.when(F.col("lat") < 0, "S").otherwise("N")
    packed = F.format_string("%03d%02d%02d%s", key % 90, key % 60, key % 59, south)
    spaced = F.format_string("%d:%d:%d %s", key % 90, key % 60, key % 59, south)
    text = F.when(key % 2 == 0, packed).otherwise(spaced)
    return views.collects(spark, sf_dir).select("collect_id", rounded(geodesy.parse_angle(text), 8).alias("value"))


@query(f"with {COLLECT} select collect_id, round(1+graze*0.5::double+graze*graze*0.25::double, 6) p, round(0.5::double+graze*0.5::double, 6) dp, round(graze+graze*graze*0.25::double+graze*graze*graze/12, 4) ip, round(1+(graze+2)*0.5::double+(graze+2)*(graze+2)*0.25::double, 6) sp, round((1+graze*0.5::double+graze*graze*0.25::double)*(2-graze), 4) + 0.0 pp from co")
def polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, x = F.array(*map(F.lit, [1.0, 0.5, 0.25])), F.col("graze")
    value = {"p": poly.polyval(c, x), "dp": poly.polyval(poly.derivative(c), x), "ip": poly.polyval(poly.integral(c), x), "sp": poly.polyval(poly.shifted(c, F.lit(2.0)), x), "pp": poly.polyval(poly.product(c, F.array(F.lit(2.0), F.lit(-1.0))), x)}
    digits = {"ip": 4, "pp": 4}
    return views.collects(spark, sf_dir).select("collect_id", *[rounded(v, digits.get(k, 6)).alias(k) for k, v in value.items()])


@query(f"with {COLLECT} select collect_id, round(1+2*graze+3*graze*azim+4*azim, 4) \"value\" from co")
def polynomial_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.array(F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(2.0), F.lit(3.0)))
    return views.collects(spark, sf_dir).select("collect_id", rounded(poly.polyval2d(c, F.col("graze"), F.col("azim")), 4).alias("value"))


# Geometry of a collection

#: A platform 700 km from the scene centre's meridian point, in the order of the pulses.
_GEO = (
    f"with {PULSE}, g0 as (select vec, tx_x ax, tx_y ay, tx_z az, srp_x sx, srp_y sy, srp_z sz, 100.0::double vx, 7000.0::double vy, 500.0::double vz, 0.05::double*(vec::double-250) d from pu),"
    " g1 as (select *, sx-ax lx, sy-ay ly, sz-az lz, sqrt((sx-ax)*(sx-ax)+(sy-ay)*(sy-ay)+(sz-az)*(sz-az)) rg, sqrt(ax*ax+ay*ay+az*az) an, sqrt(vx*vx+vy*vy+vz*vz) vn from g0),"
    " g2 as (select *, lx/rg ux, ly/rg uy, lz/rg uz, sign(((ay*vz-az*vy)*lx+(az*vx-ax*vz)*ly+(ax*vy-ay*vx)*lz)) look from g1),"
    # The normal at (a, 0, 0) is (1, 0, 0), so ground is the y-z plane.
    " g3 as (select *, look*(vy*uz-vz*uy) nx, look*(vz*ux-vx*uz) ny, look*(vx*uy-vy*ux) nz, sqrt(uy*uy+uz*uz) gn from g2),"
    " g4 as (select *, sqrt(nx*nx+ny*ny+nz*nz) nn, -uy/gn gy, -uz/gn gz from g3),"
    " g5 as (select *, nx/nn px, ny/nn py, nz/nn pz from g4)"
    " select vec, case when look < 0 then 'R' else 'L' end side, round(rg, 3) slant_range, round(sx*acos(ax*sx/(sx*an)), 2) ground_range, round(degrees(acos((vx*ux+vy*uy+vz*uz)/vn)), 5) doppler_cone,"
    " round(degrees(asin(-ux)), 5) graze, round(90-degrees(asin(-ux)), 5) incidence, round(-degrees(asin(-gz*py+gy*pz)), 5) + 0.0 twist, round(degrees(acos(px)), 5) slope,"
    " round(((degrees(atan2(gy, gz))+360)%360), 5) azimuth, round(((degrees(atan2(-py/px, -pz/px))+360)%360), 5) layover from g5"
)


def _velocity() -> Vec:
    return Vec(F.lit(100.0), F.lit(7000.0), F.lit(500.0))


@query(_GEO)
def scpcoa_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.with_angles(views.pulses(spark, sf_dir), vec("srp"), vec("tx"), _velocity())
    digits = {"slant_range": 3, "ground_range": 2}
    return out.select("vec", "side", *[rounded(F.col(k), digits.get(k, 5)).alias(k) for k in geometry.ANGLES[1:]])


_VG = (
    f"with {PULSE}, a as (select vec, tx_x-srp_x px, tx_y py, tx_z pz, tx_x ax, tx_y ay, tx_z az, sqrt(tx_x*tx_x+tx_y*tx_y+tx_z*tx_z) an, sqrt(100.0::double*100+7000.0::double*7000+500.0::double*500) vn from pu),"
    " b as (select *, sqrt(px*px+py*py+pz*pz) pn from a),"
    # Unit vectors: platform p, flight f; the normal of the ground is x.
    " c as (select *, px/pn p1, py/pn p2, pz/pn p3, 100/vn f1, 7000/vn f2, 500/vn f3, ax/an u1, ay/an u2, az/an u3 from b),"
    " d as (select *, p2*f3-p3*f2 s1, p3*f1-p1*f3 s2, p1*f2-p2*f1 s3, sqrt(p2*p2+p3*p3) gn, 100*u1+7000*u2+500*u3 climb, -(px*u1+py*u2+pz*u3) drop_ from c),"
    " e as (select *, sign(s1) sense, abs(s1)/sqrt(s1*s1+s2*s2+s3*s3) n1, sign(s1)*s2/sqrt(s1*s1+s2*s2+s3*s3) n2, sign(s1)*s3/sqrt(s1*s1+s2*s2+s3*s3) n3, p2/gn g2, p3/gn g3 from d),"
    # The slant normal crossed with the ground's: (0, n3, -n2).
    " f as (select *, asin(p1) graze, acos(n1) slope, sign(asin((g2*n3-g3*n2)/sqrt(n2*n2+n3*n3))) lay from e),"
    " g as (select *, -acos(least(1, greatest(-1, cos(slope)/cos(graze))))*lay tilt, 100-climb*u1 l1, 7000-climb*u2 l2, 500-climb*u3 l3, -px-drop_*u1 m1, -py-drop_*u2 m2, -pz-drop_*u3 m3 from f),"
    " h as (select *, (l2*m3-l3*m2)*u1+(l3*m1-l1*m3)*u2+(l1*m2-l2*m1)*u3 turn, l1*m1+l2*m2+l3*m3 ahead, sqrt(f2*f2+f3*f3) fn from g)"
)


@query(
    _VG + " select vec, round(degrees(atan2(turn, ahead)), 5) + 0.0 squint, round(degrees(tilt), 5) + 0.0 tilt, round(degrees(-atan(tan(tilt)*sin(graze))), 5) + 0.0 multipath,"
    " round(degrees(-sense*acos(least(1, greatest(-1, -(g2*f2+g3*f3)/fn)))), 5) + 0.0 track, round(degrees(asin(f1)), 5) + 0.0 flight_elevation, round(-sense, 5) + 0.0 \"right\", 1.0::double ascending from h"
)
def vect2geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.with_pointing(views.pulses(spark, sf_dir), vec("srp"), vec("tx"), _velocity())
    return out.select("vec", *[rounded(F.col(k), 5).alias(k) for k in geometry.POINTING])


GRID = geometry.PlaneGrid(
    scp=(geodesy.SEMI_MAJOR, 0.0, 0.0),
    row=(0.0, 0.0, -1.0),
    col=(0.0, 1.0, 0.0),
    row_spacing=2.0,
    col_spacing=3.0,
    scp_row=10,
    scp_col=16,
    arp=(7000000.0, 10000.0, 500000.0),
    velocity=(0.0, 7500.0, 100.0),
)


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the test image."""
    return views.pixels(spark, sf_dir).select("r", "c")


@query(
    # The ground plane at (a, 0, 0) is x = a and holds the image plane, so a pixel is its own ground point.
    f"with {PX} select r, c, {geodesy.SEMI_MAJOR!r}::double x, round(3.0::double*(c-16), 3) + 0.0 y, round(-2.0::double*(r-10), 3) + 0.0 z from px"
)
def project_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.image_to_plane(_lattice(spark, sf_dir), GRID)
    return out.select("r", "c", *[rounded(F.col(f"out_{a}"), 3).alias(a) for a in "xyz"])


@query()
def project_hae(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.image_to_height(_lattice(spark, sf_dir), GRID, 120.0)
    return out.select("r", "c", rounded(F.col("lat"), 7).alias("lat"), rounded(F.col("lon"), 7).alias("lon"))


@query(f"with {PX} select r, c, r::double as row, c::double col from px")
def scene_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from the ground to the pixels that it was reached from."""
    ground = geometry.image_to_height(_lattice(spark, sf_dir), GRID, 120.0)
    points = ground.select("r", "c", F.col("out_x").alias("x"), F.col("out_y").alias("y"), F.col("out_z").alias("z"))
    out = geometry.scene_to_image(points, GRID, steps=4, tolerance=1e-4)
    return out.select("r", "c", rounded(F.col("row"), 3).alias("row"), rounded(F.col("col"), 3).alias("col"))


@query(
    f"with {COLLECT}, s as (select collect_id, 20 + collect_id % 50 n, 32 + collect_id % 7 m from co)"
    " select collect_id, 'FRFC' corner, 0::bigint r, 0::bigint c from s union all select collect_id, 'FRLC', 0, m-1 from s union all select collect_id, 'LRLC', n-1, m-1 from s union all select collect_id, 'LRFC', n-1, 0 from s"
)
def corner_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of every collect's image, of a size of its own."""
    k = F.col("collect_id")
    sizes = views.collects(spark, sf_dir).select("collect_id", (20 + k % 50).alias("rows"), (32 + k % 7).alias("cols"))
    return geometry.with_corners(sizes, F.col("rows"), F.col("cols")).select("collect_id", "corner", "r", "c")


@query(f"with {COLLECT} select collect_id, round(5*lat + 2*lon + 100, 6) + 0.0 elev from co")
def dem_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a plane, bilinear interpolation is exact."""
    grid = spark.range(-61, 62).select(F.col("id").alias("ilat")).join(spark.range(-181, 182).select(F.col("id").alias("ilon"))).withColumn("elev", 5.0 * F.col("ilat") + 2.0 * F.col("ilon") + 100)
    points = views.collects(spark, sf_dir).select("collect_id", "lat", "lon")
    return geometry.bilinear(points, grid, 1.0).select("collect_id", rounded(F.col("elev")).alias("elev"))


# Metadata

_K = 1.0 / math.log(2)
_TRANSITION = math.exp(1 - metadata.RATING_OFFSET * math.log(2) / metadata.RATING_SLOPE)


@query(
    f"with {COLLECT}, b as (select collect_id, pow(2*(1e6::double*(100+collect_id%500))/299792458.0::double*cos(radians(graze)), 2)*log2(1+(case when pol in ('H:H', 'V:V') then 1.0::double else 0.25::double end)/pow(10.0::double, -2.0::double)) bits from co)"
    f" select collect_id, round(bits, 5) bits, round(case when bits < {_TRANSITION!r}::double then bits*({metadata.RATING_SLOPE!r}::double/({math.log(2)!r}::double*{_TRANSITION!r}::double)) else {metadata.RATING_SLOPE!r}::double*log2(bits)+{metadata.RATING_OFFSET!r}::double end, 5) rating from b"
)
def rgiqe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits, rating = metadata.quality(1e6 * (100 + F.col("collect_id") % 500), F.lit(-20.0), F.col("graze"), metadata.assumed_signal(F.col("pol")))
    return views.collects(spark, sf_dir).select("collect_id", rounded(bits, 5).alias("bits"), rounded(rating, 5).alias("rating"))


@query(
    f"with {COLLECT}, m as (select collect_id, case collect_id%3 when 0 then null else 1e8::double end bw, case collect_id%3 when 1 then null else 1e-5::double end len, case collect_id%3 when 2 then null else 1e13::double end rt from co)"
    " select collect_id, round(coalesce(bw, len*rt), 3) bandwidth, round(coalesce(len, coalesce(bw, len*rt)/rt), 9) length, round(coalesce(rt, coalesce(bw, len*rt)/coalesce(len, coalesce(bw, len*rt)/rt)), 0) rate, round(9.6e9::double, 1) tx_min, round(9.6e9::double+coalesce(bw, len*rt), 1) tx_max from m"
)
def waveform_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("collect_id") % 3
    base = views.collects(spark, sf_dir).select("collect_id", F.when(k != 0, 1e8).alias("bandwidth"), F.when(k != 1, 1e-5).alias("length"), F.when(k != 2, 1e13).alias("rate"), F.lit(9.6e9).alias("start_frequency"))
    out = metadata.waveform(base)
    return out.select("collect_id", F.round("bandwidth", 3).alias("bandwidth"), F.round("length", 9).alias("length"), F.round("rate", 0).alias("rate"), F.round("tx_min", 1).alias("tx_min"), F.round("tx_max", 1).alias("tx_max"))


@query(
    f"with {COLLECT}, b as (select collect_id, graze, 50.0::double slope, case when collect_id%2=0 then 2.0::double else 3.0::double/cos(radians(50.0::double)) end b from co)"
    " select collect_id, round(b, 6) beta0, round(b*12, 6) rcs, round(case when collect_id%2=0 then b*cos(radians(slope)) else 3.0 end, 6) sigma0, round(b*cos(radians(slope))/sin(radians(graze)), 6) gamma0 from b"
)
def radiometric_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("collect_id") % 2 == 0
    none = F.lit(None).cast("double")
    base = views.collects(spark, sf_dir).select("collect_id", "graze", F.lit(50.0).alias("slope"), F.lit(12.0).alias("pixel_area"), F.when(even, 2.0).alias("beta0"), none.alias("rcs"), F.when(~even, 3.0).alias("sigma0"), none.alias("gamma0"))
    return metadata.radiometric(base).select("collect_id", *[rounded(F.col(x)).alias(x) for x in ("beta0", "rcs", "sigma0", "gamma0")])


@query(
    f"with {COLLECT} select collect_id, round(cos(radians(50.0::double))/12, 8) sigma0, round(1/12.0::double, 8) beta0, round(cos(radians(50.0::double))/(sin(radians(graze))*12), 8) gamma0, round(pow(10.0::double, -25.0::double/10)*2, 8) noise from co"
)
def radiometric_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.lit(12.0), F.lit(50.0), F.col("graze"))
    return views.collects(spark, sf_dir).select("collect_id", *[F.round(metadata.measure_scale(k, *args), 8).alias(k) for k in ("sigma0", "beta0", "gamma0")], F.round(metadata.predicted_noise(F.lit(-25.0), F.lit(2.0)), 8).alias("noise"))


@query(
    f"with {COLLECT}, f as (select collect_id, unnest([case when graze < 25 then 'graze_low' end, case when pol in ('H:V', 'V:H') then 'cross_polar' end, case when side = 'L' and azim > 350 then 'side_azimuth' end]) rule from co)"
    " select collect_id, rule, case rule when 'side_azimuth' then 'Warning' else 'Info' end \"level\" from f where rule is not null"
)
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.findings(views.collects(spark, sf_dir), "collect_id", metadata.collect_rules()).select("collect_id", "rule", "level")


@query(f"with {COLLECT} select collect_id, (collect_id%7 > 1 or (collect_id%7 = 1 and collect_id%5 >= 2)) newer from co")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat_ws(".", (F.col("collect_id") % 7).cast("string"), (F.col("collect_id") % 5).cast("string"))
    return views.collects(spark, sf_dir).select("collect_id", metadata.version_at_least(version, "1.2.0").alias("newer"))


# Pulses


@query(
    f"with {PULSE}, d as (select vec, srp_x, tx_x-srp_x ax, tx_y ay, tx_z az, tx_x+20000-srp_x bx, tx_y-90000 by_, tx_z+40000 bz from pu),"
    " n as (select *, sqrt(ax*ax+ay*ay+az*az) na, sqrt(bx*bx+by_*by_+bz*bz) nb from d),"
    " h as (select *, (ax/na+bx/nb)/2 hx, (ay/na+by_/nb)/2 hy, (az/na+bz/nb)/2 hz from n),"
    " g as (select *, sqrt(hx*hx+hy*hy+hz*hz) s, (na+nb)/2 range from h)"
    " select vec, round(srp_x+hx/s*range, 3) x, round(hy/s*range, 3) + 0.0 y, round(hz/s*range, 3) + 0.0 z, round(s, 6) + 0.0 scale from g"
)
def bistatic_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equivalent position on the bisector of transmitter and receiver."""
    pulses = views.pulses(spark, sf_dir).withColumns({"rcv_x": F.col("tx_x") + 20000, "rcv_y": F.col("tx_y") - 90000, "rcv_z": F.col("tx_z") + 40000})
    p, scale = formation.bistatic_position(vec("tx"), vec("rcv"), vec("srp"))
    return pulses.select("vec", *[rounded(getattr(p, a), 3).alias(a) for a in "xyz"], rounded(scale).alias("scale"))


@query(
    f"with {PULSE}, s as (select vec, (tx_x-srp_x)/n x, (tx_y-srp_y)/n y, (tx_z-srp_z)/n z from (select *, sqrt((tx_x-srp_x)*(tx_x-srp_x)+(tx_y-srp_y)*(tx_y-srp_y)+(tx_z-srp_z)*(tx_z-srp_z)) n from pu)),"
    " e as (select acos(least(1, a.x*b.x+a.y*b.y+a.z*b.z)) angle, (select count(*) from pu) n from s a, s b where a.vec = (select min(vec) from s) and b.vec = (select max(vec) from s))"
    " select round(299792458.0::double/2e6, 4) range_extent, round(299792458.0::double/(2*(angle/n)*(9.6e9::double+1e6*31/2)), 3) cross_extent, round(299792458.0::double/(2e6*32), 4) range_resolution, round(299792458.0::double/(2*angle*(9.6e9::double+1e6*31/2)), 4) cross_resolution from e"
)
def resolution_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formation.resolution_extent(views.pulses(spark, sf_dir), SAMPLES)
    return out.select(F.round("range_extent", 4).alias("range_extent"), F.round("cross_extent", 3).alias("cross_extent"), F.round("range_resolution", 4).alias("range_resolution"), F.round("cross_resolution", 4).alias("cross_resolution"))


@query(
    f"with {PULSE}, d as (select vec, tx_x-srp_x x, tx_y-srp_y y, tx_z-srp_z z from pu), n as (select vec, x, y, (tx_z) z, sqrt(x*x+y*y+z*z) n from d join (select vec v2, tx_z from pu) on v2 = vec)"
    " select vec, round(-atan2(y, z), 8) + 0.0 k_a, round(sqrt(1-(x/n)*(x/n)), 8) k_sf from n"
)
def polar_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image plane is the ground plane x = a, the reference is due north of the centre."""
    scp = (geodesy.SEMI_MAJOR, 0.0, 0.0)
    out = formation.polar_coordinates(views.pulses(spark, sf_dir), (7000000.0, 0.0, 500000.0), scp, (1.0, 0.0, 0.0), (1.0, 0.0, 0.0))
    return out.select("vec", rounded(F.col("k_a"), 8).alias("k_a"), rounded(F.col("k_sf"), 8).alias("k_sf"))


@query(f"with {PX} select r, c, round(re*(1+(r%10)*0.1::double), 6) + 0.0 re, round(im*(1+(r%10)*0.1::double), 6) + 0.0 im from px")
def amp_sf_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = 1 + (F.col("r") % 10) * 0.1
    return views.pixels(spark, sf_dir).select("r", "c", rounded(F.col("re") * scale).alias("re"), rounded(F.col("im") * scale).alias("im"))


@query(
    f"with {PX}, {HEIGHT}, a as (select r, ((c-16+32)%32) c, re, im from px), {dft_sql(SAMPLES, True, 'a', 'f1')}, b as (select ((k+16)%32) r, ((r-height//2+height)%height) c, re, im from f1, he), {dft_columns('b', 'f2', True)}"
    " select (k+height//2)%height r, r c, round(re*1000, 4) + 0.0 re, round(im*1000, 4) + 0.0 im from f2, he"
)
def rgaz_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.spectral import unpacked

    out = unpacked(formation.range_azimuth(views.lines(spark, sf_dir)))
    return out.select("r", "c", rounded(F.col("re") * 1000, 4).alias("re"), rounded(F.col("im") * 1000, 4).alias("im"))


def _signals(spark: SparkSession, sf_dir: str, target: tuple[float, float, float]) -> DataFrame:
    """Echoes of one point, for the pulse view."""
    d = F.sqrt((F.col("tx_x") - target[0]) ** 2 + (F.col("tx_y") - target[1]) ** 2 + (F.col("tx_z") - target[2]) ** 2)
    to_srp = F.sqrt((F.col("tx_x") - F.col("srp_x")) ** 2 + F.col("tx_y") ** 2 + F.col("tx_z") ** 2)
    pulses = views.pulses(spark, sf_dir).withColumn("_d", 2 * (d - to_srp))
    phase = lambda k: -2 * math.pi * (F.col("sc0") + F.col("scss") * k) / geodesy.LIGHT * F.col("_d")
    z = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.struct(F.cos(phase(k)).alias("re"), F.sin(phase(k)).alias("im")))
    return pulses.withColumn("z", z).drop("_d")


_C = f"{geodesy.LIGHT!r}::double"
_D = "2*(sqrt(pow(tx_x-{x}, 2)+pow(tx_y-{y}, 2)+pow(tx_z-{z}, 2))-sqrt(pow(tx_x-srp_x, 2)+tx_y*tx_y+tx_z*tx_z))"
_BP = (
    f"with {PULSE}, d as (select vec, sc0, scss, {_D.format(x=repr(geodesy.SEMI_MAJOR) + '::double', y='8.0::double', z='(-12.0::double)')} d from pu),"
    f" sg as (select vec, k, cos(-2*pi()*(sc0+scss*k)/{_C}*d) re, sin(-2*pi()*(sc0+scss*k)/{_C}*d) im from d, range(32) t(k)),"
    " pf as (select vec, m, sum(re*cos(2*pi()*(((m+128)%256)*k%256)/256)-im*sin(2*pi()*(((m+128)%256)*k%256)/256))/256 re, sum(re*sin(2*pi()*(((m+128)%256)*k%256)/256)+im*cos(2*pi()*(((m+128)%256)*k%256)/256))/256 im from sg, range(256) t(m) group by 1, 2),"
    f" px_at as (select r, c, vec, sc0, {_D.format(x=repr(geodesy.SEMI_MAJOR) + '::double', y='((c-8)*4.0::double)', z='((r-8)*4.0::double)')} d, scss from pu, range(17) a(r), range(17) b(c)),"
    f" pl as (select r, c, vec, d, sc0, floor(d*scss/{_C}*256+128)::bigint lo, d*scss/{_C}*256+128 - floor(d*scss/{_C}*256+128) w from px_at where d*scss/{_C}*256+128 > 0 and d*scss/{_C}*256+128 < 255),"
    f" v as (select r, c, a.re*(1-w)+b.re*w re, a.im*(1-w)+b.im*w im, 2*pi()*sc0/{_C}*d p from pl join pf a on a.vec=pl.vec and a.m=lo join pf b on b.vec=pl.vec and b.m=lo+1)"
)


@query(_BP + " select r, c, round(sqrt(pow(sum(re*cos(p)-im*sin(p)), 2)+pow(sum(re*sin(p)+im*cos(p)), 2)), 4) amplitude from v group by 1, 2")
def bp_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backprojection of a point target; the peak is at its pixel."""
    pixels = [(r, c, geodesy.SEMI_MAJOR, (c - 8) * 4.0, (r - 8) * 4.0) for r in range(17) for c in range(17)]
    out = formation.backprojection(_signals(spark, sf_dir, (geodesy.SEMI_MAJOR, 8.0, -12.0)), pixels)
    return out.select("r", "c", rounded(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 4).alias("amplitude"))


@query()
def pfa_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.spectral import unpacked

    scp = (geodesy.SEMI_MAJOR, 0.0, 0.0)
    polar = formation.polar_coordinates(views.pulses(spark, sf_dir), (7000000.0, 0.0, 500000.0), scp, (1.0, 0.0, 0.0), (1.0, 0.0, 0.0))
    out = unpacked(formation.polar_format(_signals(spark, sf_dir, scp), polar))
    return out.select("r", "c", rounded(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 4).alias("amplitude"))


@query(
    f"with {PULSE} select vec, round(7000000.0::double*cos((vec::double-250)*0.00002), 2) x, round(7000000.0::double*sin((vec::double-250)*0.00002), 2) + 0.0 y from pu"
)
def poly_fit_arp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from the fitted polynomials, to a centimetre those that they were fitted to."""
    pulses = views.pulses(spark, sf_dir)
    centre, half, (fx, fy) = formation.fitted_series(pulses, "tx_time", ["tx_x", "tx_y"], 1e-7)
    value = lambda c: poly.chebyshev(F.array(*map(F.lit, c)), (F.col("tx_time") - centre) / half)
    return pulses.select("vec", rounded(value(fx), 2).alias("x"), rounded(value(fy), 2).alias("y"))
