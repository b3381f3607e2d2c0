"""Queries over frames, polynomials, sensors' tables and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy, poly
from ..functions.cx import rounded
from ..functions.vectors import Vec, rotated, vec
from ..operators import change, filters, formation, measures, metadata, raster, sensors, spectral
from ..sources import probe
from . import views
from .collects import ECF, _ecf
from .pixels import LOCAL, dft_sql
from .views import COLLECT, HEIGHT, PAIR, PULSE, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _xyz(v: Vec, digits: int) -> list:
    return [rounded(getattr(v, a), digits).alias(a) for a in "xyz"]


@query(
    f"with {COLLECT} select collect_id, round((degrees(atan2(sin(radians(lon-20))*cos(radians(lat)), cos(radians(10.0::double))*sin(radians(lat))-sin(radians(10.0::double))*cos(radians(lat))*cos(radians(lon-20))))+360)%360, 5) + 0.0 bearing from co"
)
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = geodesy.bearing(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lon"))
    return views.collects(spark, sf_dir).select("collect_id", rounded(value, 5).alias("bearing"))


@query(
    f"with {ECF}, a as (select collect_id, x/sqrt(x*x+y*y+z*z) ux, y/sqrt(x*x+y*y+z*z) uy, z/sqrt(x*x+y*y+z*z) uz from ecf),"
    " b as (select *, uy*500-uz*7000 cx, uz*100-ux*500 cy, ux*7000-uy*100 cz from a), c as (select *, cx/sqrt(cx*cx+cy*cy+cz*cz) kx, cy/sqrt(cx*cx+cy*cy+cz*cz) ky, cz/sqrt(cx*cx+cy*cy+cz*cz) kz from b)"
    " select collect_id, round(ky*uz-kz*uy, 7) + 0.0 x, round(kz*ux-kx*uz, 7) + 0.0 y, round(kx*uy-ky*ux, 7) + 0.0 z from c"
)
def in_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The in-track axis of a platform's radial frame."""
    _, along, _ = geodesy.radial_frame(vec("p"), Vec(F.lit(100.0), F.lit(7000.0), F.lit(500.0)))
    return _ecf(spark, sf_dir).select("collect_id", *_xyz(along, 7))


@query(
    f"with {ECF}, v as (select collect_id, x, y, z, radians(lat) p, radians(lon) l, 100*cos(radians(azim))+200*sin(radians(azim)) n, 100*sin(radians(azim))-200*cos(radians(azim)) e, -50.0::double d from ecf)"
    " select collect_id, round(x-sin(p)*cos(l)*n-sin(l)*e-cos(p)*cos(l)*d, 3) + 0.0 x, round(y-sin(p)*sin(l)*n+cos(l)*e-cos(p)*sin(l)*d, 3) + 0.0 y, round(z+cos(p)*n-sin(p)*d, 3) + 0.0 z from v"
)
def plane_to_ecf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geodesy.from_plane(Vec(F.lit(100.0), F.lit(200.0), F.lit(50.0)), F.col("lat"), F.col("lon"), F.col("hae"), F.col("azim"))
    return views.collects(spark, sf_dir).select("collect_id", *_xyz(out, 3))


@query(
    f"with {PULSE}, a as (select vec, tx_x/1e6 x, tx_y/1e6 y, tx_z/1e6 z, radians(vec%360) t from pu), k as (select *, (2*x-y+2*z)/3 d from a)"
    " select vec, round(x*cos(t)+(-1.0/3*z-2.0/3*y)*sin(t)+2.0/3*d*(1-cos(t)), 6) + 0.0 x, round(y*cos(t)+(2.0/3*x-2.0/3*z)*sin(t)-1.0/3*d*(1-cos(t)), 6) + 0.0 y, round(z*cos(t)+(2.0/3*y+1.0/3*x)*sin(t)+2.0/3*d*(1-cos(t)), 6) + 0.0 z from k".replace("1.0/3", "(1.0::double/3)").replace("2.0/3", "(2.0::double/3)")
)
def rotated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions turned about the axis (2, -1, 2) / 3."""
    p = vec("tx") * 1e-6
    axis = Vec(F.lit(2 / 3), F.lit(-1 / 3), F.lit(2 / 3))
    return views.pulses(spark, sf_dir).select("vec", *_xyz(rotated(p, axis, F.radians(F.col("vec") % 360)), 6))


@query(
    f"with {PULSE}, k as (select vec, (vec%7)::double a, (vec%5)::double b, (vec%3)::double h from pu)"
    " select vec, round(a*2, 6) + 0.0 p0, round(2*b-3*a, 6) + 0.0 p1, round(-3*b, 6) + 0.0 p2, round(a+b*h+2*h*h, 6) + 0.0 s0, round(b+4*h, 6) + 0.0 s1, 2.0::double s2 from k"
)
def polynomial_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a + b x)(2 - 3 x), and a + b x + 2 x**2 moved by h."""
    v = F.col("vec")
    a, b, h = (v % 7).cast("double"), (v % 5).cast("double"), (v % 3).cast("double")
    product = poly.product(F.array(a, b), F.array(F.lit(2.0), F.lit(-3.0)))
    moved = poly.shifted(F.array(a, b, F.lit(2.0)), h)
    return views.pulses(spark, sf_dir).select("vec", *[rounded(F.get(product, k)).alias(f"p{k}") for k in range(3)], *[rounded(F.get(moved, k)).alias(f"s{k}") for k in range(3)])


@query(f"with {COLLECT} select collect_id, case when pol in ('H:H', 'V:V') then 1.0::double else 0.25::double end signal, round(pow(10.0::double, -graze/10)*(1+collect_id%3), 9) noise from co")
def noise_and_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = metadata.predicted_noise(-F.col("graze"), 1 + F.col("collect_id") % 3)
    return views.collects(spark, sf_dir).select("collect_id", metadata.assumed_signal(F.col("pol")).alias("signal"), F.round(noise, 9).alias("noise"))


@query(f"with {COLLECT} select collect_id, 9.6e9::double + graze tx_min, 9.6e9::double + azim tx_max from co")
def frequency_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.collects(spark, sf_dir).select("collect_id", F.col("graze").alias("tx_min"), F.col("azim").alias("tx_max"))
    return metadata.shifted_frequencies(rows, F.lit(9.6e9), ["tx_min", "tx_max"])


@query(f"with {COLLECT} select collect_id, pol, round(graze+azim+hae, 4) total, 3 numbers from co")
def xml_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and vectors of numbers out of a product's description."""
    xml = F.format_string("<p><pol>%s</pol><list n='3'>%.4f %.4f  %.4f</list></p>", "pol", "graze", "azim", "hae")
    out = sensors.xml_fields(views.collects(spark, sf_dir).select("collect_id", xml.alias("xml")), "xml", {"pol": ("/p/pol", "string"), "list": ("/p/list", "array<double>"), "n": ("/p/list/@n", "int")})
    return out.select("collect_id", "pol", F.round(F.aggregate("list", F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.col("n").alias("numbers"))


@query("select event_id, json_extract(props, '$.k')::int k from events")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors.json_fields(views.table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": ("$.k", "int")}).select("event_id", "k")


@query("select l_orderkey, case when min(l_quantity) = max(l_quantity) then round(1/(min(l_quantity)*min(l_quantity)), 9) end beta0 from lineitem group by 1")
def constant_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_quantity").alias("lut"))
    return sensors.constant_calibration(tables, "l_orderkey", "lut").select("l_orderkey", F.round("beta0", 9).alias("beta0"))


@query("select distinct l_linenumber burst, l_linenumber::double c0, 0.5::double c1, -0.01::double c2 from lineitem")
def noise_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each burst's table follows a parabola in decibels, which is found again."""
    q = F.col("l_quantity")
    vectors = views.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("burst"), F.array(q).alias("pixels"), F.array(F.pow(10.0, (F.col("l_linenumber") + 0.5 * q - 0.01 * q * q) / 10)).alias("lut"))
    found = sensors.noise_polynomials(vectors, "burst", "pixels", "lut", 2)
    return spark.createDataFrame([(k, *(round(x, 6) + 0.0 for x in v)) for k, v in found.items()], "burst int, c0 double, c1 double, c2 double")


@query("select l_suppkey burst, round(regr_intercept(10*log10(l_extendedprice), l_quantity), 6) + 0.0 c0, round(regr_slope(10*log10(l_extendedprice), l_quantity), 6) + 0.0 c1 from lineitem group by 1")
def noise_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through scattered tables, one for each burst."""
    vectors = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("burst"), F.array("l_quantity").alias("pixels"), F.array("l_extendedprice").alias("lut"))
    found = sensors.noise_fits(vectors, "burst", "pixels", "lut", 1)
    return found.select("burst", *(rounded(F.get("db_poly", F.lit(k))).alias(f"c{k}") for k in range(2)))


@query("select m, n, c from (values (0, 0, 1.0::double), (0, 1, -3.0::double), (1, 0, 2.0::double), (1, 1, 0.5::double)) t(m, n, c)")
def surface_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coefficients of a surface over all pixels."""
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    samples = views.pixels(spark, sf_dir).select(r.alias("x"), c.alias("y"), (1 + 2 * r - 3 * c + 0.5 * r * c).alias("v"))
    found = sensors.surface_polynomial(samples, "x", "y", "v", 1, 1)
    return spark.createDataFrame([(m, n, round(v, 5) + 0.0) for m, row in enumerate(found) for n, v in enumerate(row)], "m int, n int, c double")


@query(f"with {PULSE} select vec, round(100+2*tx_time+3*tx_time*tx_time, 4) x, round(7500*tx_time, 4) + 0.0 y, round(5e5::double-tx_time*tx_time*tx_time, 4) z from pu")
def position_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from polynomials whose order the fit chose."""
    t = F.col("tx_time")
    states = views.pulses(spark, sf_dir).select("vec", t.alias("t"), (100 + 2 * t + 3 * t * t).alias("x"), (7500 * t).alias("y"), (5e5 - t * t * t).alias("z"))
    fits = sensors.position_polynomial(states)
    return states.select("vec", *[rounded(poly.polyval(F.array(*map(F.lit, c)), F.col("t")), 4).alias(a) for a, c in zip("xyz", fits, strict=True)])


@query(
    f"with {PULSE} select vec, round((lead(tx_x) over w-tx_x)/(lead(tx_time) over w-tx_time), 3) + 0.0 v_x, round((lead(tx_y) over w-tx_y)/(lead(tx_time) over w-tx_time), 3) + 0.0 v_y from pu window w as (order by tx_time)"
)
def pulse_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formation.velocity(views.pulses(spark, sf_dir).withColumn("channel", F.lit("1")))
    return out.select("vec", rounded(F.col("v_x"), 3).alias("v_x"), rounded(F.col("v_y"), 3).alias("v_y"))


_ANGLE = f"(0.886::double*{geodesy.LIGHT!r}::double/(2*12.0::double*(9.6e9::double+1e6::double*31/2)))"


@query(
    f"with {PULSE}, s as (select vec, (tx_x-srp_x)/n x, tx_y/n y, tx_z/n z from (select *, sqrt(pow(tx_x-srp_x, 2)+tx_y*tx_y+tx_z*tx_z) n from pu)), m as (select * from s where vec = (select (min(vec)+max(vec))//2 from s))"
    f" select s.vec, 10 first, 22 last from s, m where acos(least(1, s.x*m.x+s.y*m.y+s.z*m.z)) <= {_ANGLE}/2"
)
def selected_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses and samples for 12 m; ceil(0.886 c / 24 / 1 MHz) = 12 of 32 samples, centred."""
    kept, first, last = formation.selected(views.pulses(spark, sf_dir), 12.0, SAMPLES)
    return kept.select("vec", F.lit(first).alias("first"), F.lit(last).alias("last"))


@query(
    f"with {COLLECT}, d as (select collect_id, graze/5 d, 5e5::double + hae h from co) select collect_id, (range*10)::int percent, round((degrees(atan2((range*10/100.0::double*d-d/2)*7500, h))+360)%360, 6) azimuth from d, range(11)"
)
def aperture_azimuths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuths over the aperture of every collect."""
    out = measures.azimuth_over_aperture(views.collects(spark, sf_dir).select("collect_id", "graze", "hae"), F.col("graze") / 5, 7500.0, 5e5 + F.col("hae"))
    return out.select("collect_id", "percent", rounded(F.col("azimuth")).alias("azimuth"))


@query(
    LOCAL + f", {HEIGHT}, i as (select k from lo, he where r between 2 and height-3 and c between 2 and 29), e as (select quantile_cont(k, 0.1) edge from i) select round(1/avg(k), 6) looks from i, e where k <= edge"
)
def trimmed_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of looks from the most even tenth of the interior."""
    local = filters.local_statistics(views.pixels(spark, sf_dir), 2)
    return filters.looks(local, 2, views.height(spark, sf_dir), SAMPLES).select(F.round("looks", 6).alias("looks"))


_F = "((k+16)%32-16)/32.0::double"


@query(
    f"with {PX}, {dft_sql(SAMPLES)}, ds as (select r, k c, re*cos(pi()*{_F}*{_F}/0.02::double)+im*sin(pi()*{_F}*{_F}/0.02::double) re, im*cos(pi()*{_F}*{_F}/0.02::double)-re*sin(pi()*{_F}*{_F}/0.02::double) im from ft), {dft_sql(SAMPLES, True, 'ds', 'bk')}"
    " select r, k c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from bk"
)
def range_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.unpacked(formation.range_deskewed(views.lines(spark, sf_dir), 0.02, 1.0))
    return out.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


_BESSEL = "(select sum(pow({x}/2, 2*m)/(factorial(m::int)::double*factorial(m::int)::double)) from range(25) b(m))"
_WINDOWS = (
    "with z as (select distinct p_size + 15 n from part), t as (select n, unnest(range(n)) k from z), w as (select 'HAMMING' window_, n, k, 0.54::double-0.46::double*cos(2*pi()*k/(n-1)) v from t union all select 'HANNING', n, k, 0.5::double-0.5::double*cos(2*pi()*k/(n-1)) from t"
    " union all select 'KAISER', n, k, " + _BESSEL.format(x="(2.5::double*sqrt(greatest(0, 1-pow(2.0::double*k/(n-1)-1, 2))))") + "/" + _BESSEL.format(x="2.5::double") + " from t"
    " union all select 'UNIFORM', n, k, 1.0::double from t),"
    " f as (select window_, n, j, sqrt(pow(sum(v*cos(2*pi()*j*k/(1024*n))), 2)+pow(sum(v*sin(2*pi()*j*k/(1024*n))), 2))/sum(v) a from w, range(400, 1000) b(j) group by 1, 2, 3),"
    " h as (select window_, n, min(j) j from f where a < 1/sqrt(2.0::double) group by 1, 2)"
    " select h.window_ \"window\", h.n::bigint n, round(2*(h.j-1+(p.a-1/sqrt(2.0::double))/(p.a-q.a))/1024, 6) width from h join f p on p.window_=h.window_ and p.n=h.n and p.j=h.j-1 join f q on q.window_=h.window_ and q.n=h.n and q.j=h.j"
)


@query(_WINDOWS)
def window_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-power broadening of windows of as many weights as parts have sizes, and 15."""
    sizes = views.table(spark, sf_dir, "part").select((F.col("p_size") + 15).alias("n")).distinct()
    out = spectral.broadenings(sizes, ["HAMMING", "HANNING", "KAISER", "UNIFORM"])
    return out.select("window", "n", F.round("width", 6).alias("width"))


@query(
    f"with {PX}, d as (select r, c, sum(re) over w re from px window w as (partition by c order by r range between 1 preceding and 2 following))"
    " select r, c, round(sum(re) over (partition by r order by c range between 2 preceding and 3 following), 6) + 0.0 re from d"
)
def boxcar_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of four lines and six columns."""
    return raster.sized_window_sums(views.pixels(spark, sf_dir), ["re"], 4, 6).select("r", "c", rounded(F.col("re")).alias("re"))


_PRODUCTS = "p as (select r, c, ar*br+ai*bi xr, ar*bi-ai*br xi, ar*ar+ai*ai pa, br*br+bi*bi pb from pr)"
_DOWN = ", ".join(f"sum({x}) over w {x}" for x in ("xr", "xi", "pa", "pb"))


@query(
    f"with {PAIR}, {_PRODUCTS}, d as (select r, c, {_DOWN} from p window w as (partition by c order by r range between 3 preceding and 3 following)), b as (select r, c, {_DOWN} from d window w as (partition by r order by c range between 1 preceding and 1 following))"
    " select r, c, round(case when pa*pb > 0 then sqrt(xr*xr+xi*xi)/sqrt(pa*pb) else 0 end, 6) + 0.0 coherence from b"
)
def turned_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of three lines and seven columns, turned once."""
    out = change.turned_coherence(views.image_pair(spark, sf_dir), 3, 7, 1)
    return out.select("r", "c", rounded(F.col("coherence")).alias("coherence"))


@query(f"with {COLLECT} select collect_id, (collect_id%90)::double block, graze lines, side frlc from co")
def extension_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of fixed width, written and read again."""
    k = F.col("collect_id")
    raw = F.concat(probe.written_field(k % 90, 2, True), F.lit("00255"), probe.written_field(F.col("graze").cast("int"), 5, True), F.lit("   " * 2), F.lit(" " * 16), *[probe.written_field(F.col("side"), 21)] * 4)
    return views.collects(spark, sf_dir).select("collect_id", raw.alias("raw")).select("collect_id", *probe.extension(F.col("raw"), "BLOCKA")).select("collect_id", "block", "lines", "frlc")


@query(f"with {COLLECT} select collect_id, i burst, i*(3+collect_id%4) first_line from co, range(8) t(i) where i*(3+collect_id%4) < 10+collect_id%9")
def burst_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = views.collects(spark, sf_dir).select("collect_id", (10 + F.col("collect_id") % 9).alias("lines"), (3 + F.col("collect_id") % 4).alias("per_burst"))
    return sensors.bursts(products, "lines", "per_burst").select("collect_id", "burst", "first_line")
