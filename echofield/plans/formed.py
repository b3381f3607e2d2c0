"""Queries over formation metadata, grids and estimates, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy
from ..functions.cx import rounded
from ..functions.vectors import vec
from ..operators import algorithms, estimates
from . import views
from .pixels import dft_sql
from .views import BANDS, COLLECT, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

A = geodesy.SEMI_MAJOR
C2 = f"(2/{geodesy.LIGHT!r}::double)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Vectors in SQL: three expressions each


def _v(name: str) -> list[str]:
    return [f"{name}_{a}" for a in "xyz"]


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"({x})*({y})" for x, y in zip(a, b, strict=True)) + ")"


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"(({a[i]})*({b[j]}) - ({a[j]})*({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]


def _minus(a: list[str], b: list[str]) -> list[str]:
    return [f"(({x}) - ({y}))" for x, y in zip(a, b, strict=True)]


def _unit(a: list[str]) -> list[str]:
    return [f"(({x}) / sqrt({_dot(a, a)}))" for x in a]


def _times(a: list[str], by: str) -> list[str]:
    return [f"(({x}) * ({by}))" for x in a]


def _stage(name: str, source: str, **columns: list[str] | str) -> str:
    """A common table expression that adds vectors (lists) and numbers (texts)."""
    added = [f"{x} {k}_{a}" for k, v in columns.items() if isinstance(v, list) for x, a in zip(v, "xyz", strict=True)]
    added += [f"{v} {k}" for k, v in columns.items() if isinstance(v, str)]
    return f"{name} as (select *, {', '.join(added)} from {source})"


def _flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and velocities for each collection of the catalog."""
    k = F.col("collect_id").cast("double")
    columns = {"scp_x": F.lit(A), "scp_y": F.lit(0.0), "scp_z": F.lit(0.0), "arp_x": 7e6 + F.pmod(k, F.lit(100.0)), "arp_y": F.pmod(k, F.lit(50.0)) * 10 - 1e5, "arp_z": F.lit(5e5), "vel_x": 10 + F.pmod(k, F.lit(7.0)), "vel_y": F.lit(7500.0), "vel_z": F.lit(20.0), "fc": 9.6e9 + k}
    return views.collects(spark, sf_dir).select("collect_id", "graze").withColumns(columns)


FLIGHT = (
    f"{COLLECT}, fl as (select collect_id, graze, {A!r}::double scp_x, 0.0::double scp_y, 0.0::double scp_z, 7e6::double + collect_id % 100 arp_x, (collect_id % 50) * 10.0::double - 1e5::double arp_y,"
    " 5e5::double arp_z, 10.0::double + collect_id % 7 vel_x, 7500.0::double vel_y, 20.0::double vel_z, 9.6e9::double + collect_id fc from co)"
)
NAMES = ("RGAZCOMP", "PFA", "RMAT", "RMCR", "INCA")
_CASES = "['RGAZCOMP', 'PFA', 'RMAT', 'RMCR', 'INCA'][collect_id % 5 + 1]"


def _when(**cases: str) -> str:
    return "case algorithm " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + " end"


_SCP, _ARP, _VEL, _UP = _v("scp"), _v("arp"), _v("vel"), ["1.0::double", "0.0::double", "0.0::double"]
_ALGORITHMS = ", ".join(
    [
        f"with {FLIGHT}",
        _stage("s1", "fl", algorithm=_CASES, los=_unit(_minus(_SCP, _ARP)), ca=[f"({p} + 0.5::double*{v})" for p, v in zip(_ARP, _VEL, strict=True)]),
        _stage("s2", "s1", look=f"sign({_dot(_cross(_ARP, _VEL), _v('los'))})", rg=_unit(_minus(_SCP, _v("ca"))), cone=f"acos({_dot(_unit(_VEL), _v('los'))})"),
        _stage("s3", "s2", sn=_times(_unit(_cross(_VEL, _v("los"))), "look"), yat=_times(_unit(_VEL), "-look"), calook=f"sign({_dot(_cross(_v('ca'), _VEL), _v('rg'))})"),
        _stage("s4", "s3", xn=_unit(_cross(_v("los"), _v("yat"))), cn=_times(_unit(_cross(_v("rg"), _VEL)), "-calook"), d=f"({_dot(_minus(_SCP, _ARP), _v('sn'))} / {_dot(_UP, _v('sn'))})"),
        _stage("s5", "s4", pr=_unit(_minus(_SCP, ["(arp_x + d)", "arp_y", "arp_z"]))),
    ]
)


@query(
    _ALGORITHMS
    + " select collect_id, algorithm, "
    + ", ".join(
        f"round({_when(RGAZCOMP=los, PFA=pr, RMAT=ct, RMCR=los, INCA=rg)}, 7) + 0.0 row_{a}, round({_when(RGAZCOMP=cr, PFA=pc, RMAT=ya, RMCR=cr, INCA=ic)}, 7) + 0.0 col_{a}"
        for a, los, pr, ct, rg, cr, pc, ya, ic in zip(
            "xyz", _v("los"), _v("pr"), _cross(_v("yat"), _v("xn")), _v("rg"), _cross(_v("sn"), _v("los")), _cross(_v("sn"), _v("pr")), _v("yat"), _cross(_v("cn"), _v("rg")), strict=True
        )
    )
    + f", round(case when algorithm = 'RMAT' then fc*{C2}*sin(cone) else fc*{C2} end, 6) k_row, round(case when algorithm = 'RMAT' then fc*{C2}*cos(cone) else 0 end, 6) + 0.0 k_col,"
    f" round(case when algorithm = 'RGAZCOMP' then -look*sin(cone)/sqrt({_dot(_minus(_SCP, _ARP), _minus(_SCP, _ARP))})*1e6::double end, 6) azimuth_scale,"
    f" round(case when algorithm = 'INCA' then sqrt({_dot(_minus(_v('ca'), _SCP), _minus(_v('ca'), _SCP))}) end, 3) closest_range from s5"
)
def algorithm_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes and centre wavenumbers by image formation algorithm; closest approach half a second later."""
    own = _flights(spark, sf_dir).withColumn("algorithm", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("collect_id") % 5 + 1).cast("int")))
    for a in "xyz":
        own = own.withColumn(f"ca_{a}", F.col(f"arp_{a}") + 0.5 * F.col(f"vel_{a}")).withColumn(f"cv_{a}", F.col(f"vel_{a}"))
    out = algorithms.algorithm_fields(own)
    axes = [rounded(F.col(f"{n}_{a}"), 7).alias(f"{n}_{a}") for n in ("row", "col") for a in "xyz"]
    return out.select("collect_id", "algorithm", *axes, rounded(F.col("k_row")).alias("k_row"), rounded(F.col("k_col")).alias("k_col"), F.round(F.col("azimuth_scale") * 1e6, 6).alias("azimuth_scale"), F.round("closest_range", 3).alias("closest_range"))


_CORNERS = "[-0.01::double*(graze-40), 0.002::double*(collect_id%9), 0.005::double*(collect_id%4), -0.001::double*(collect_id%3)]"


@query(
    f"with {COLLECT}, e as (select collect_id, list_min({_CORNERS}) - 0.4::double/2 lo, list_max({_CORNERS}) + 0.4::double/2 hi, 1/(2*(0.8::double + (collect_id%5)*0.1::double)) edge from co)"
    " select collect_id, round(case when lo < -edge or hi > edge then -edge else lo end, 8) + 0.0 low, round(case when lo < -edge or hi > edge then edge else hi end, 8) + 0.0 high from e"
)
def wavenumber_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("collect_id")
    corners = [-0.01 * (F.col("graze") - 40), 0.002 * (k % 9), 0.005 * (k % 4), -0.001 * (k % 3)]
    low, high = algorithms.wavenumber_bounds(corners, F.lit(0.4), 0.8 + (k % 5) * 0.1)
    return views.collects(spark, sf_dir).select("collect_id", rounded(low, 8).alias("low"), rounded(high, 8).alias("high"))


@query(
    f"with {FLIGHT}, e as (select collect_id, {C2}*(fc + 1e6::double*(1023)/2) centre, {C2}*1e6::double row_step, sqrt({_dot(_VEL, _VEL)}) speed, sin(radians(80+collect_id%10)) s, 8e5::double+collect_id dist from fl),"
    " f as (select *, centre*(speed*s/dist)/1000.0::double col_step from e)"
    " select collect_id, round(centre, 6) row_centre, round(1023*row_step, 6) row_bandwidth, round(0.886::double/(1023*row_step), 8) row_width, round(1/(2047*row_step), 8) row_spacing,"
    " round(511*col_step, 6) col_bandwidth, round(0.886::double/(511*col_step), 8) col_width, round(1/(1023*col_step), 8) col_spacing from f"
)
def compressed_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of range-azimuth compressed images of 1,024 samples and 512 pulses."""
    k = F.col("collect_id")
    axes = algorithms.compressed_axes(F.col("fc"), F.lit(1e6), F.lit(1024), F.lit(512), F.lit(2048), F.lit(1024), vec("vel").norm(), F.radians(80 + k % 10), 8e5 + k, F.lit(1000.0))
    digits = {"row_centre": 6, "row_bandwidth": 6, "col_bandwidth": 6}
    return _flights(spark, sf_dir).select("collect_id", *[F.round(v, digits.get(n, 8)).alias(n) for n, v in axes.items()])


@query(
    f"with {COLLECT} select collect_id, round(2.0::double + (collect_id%7)*0.25::double, 6) bandwidth, round(0.886::double/(2.0::double + (collect_id%7)*0.25::double), 8) width,"
    " round(1/(1.5::double*(2.0::double + (collect_id%7)*0.25::double)), 8) spacing, round(300 + (2.0::double + (collect_id%7)*0.25::double)/2, 6) centre from co"
)
def polar_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = 302.0 + (F.col("collect_id") % 7) * 0.25
    axis = algorithms.polar_axis(F.lit(300.0), last, 1.5)
    return views.collects(spark, sf_dir).select("collect_id", *[F.round(v, 8 if n in ("width", "spacing") else 6).alias(n) for n, v in axis.items()])


def _grid_sql(kind: str) -> str:
    mid, st, sn = _ARP, _v("st"), _v("sn")
    flight = _times(_VEL, "2")
    stages = [
        f"with {FLIGHT}",
        _stage("g1", "fl", st=_unit(_minus(_SCP, mid)), re="(400.3::double + collect_id % 13)", ce="(300.3::double + collect_id % 11)", rr="0.5::double", cr="(0.4::double + (collect_id % 3) * 0.1::double)"),
        _stage("g2", "g1", sn=_times(_unit(_cross(st, flight)), f"sign({_dot(_SCP, _cross(st, flight))})")),
    ]
    if kind == "slant":
        stages.append(_stage("g3", "g2", row=st, col=_times(_cross(st, sn), "-1"), sp="1.0::double", sr="1.0::double"))
    else:
        away = _times(st, "-1")
        stages.append(_stage("g2b", "g2", flat=_unit(_minus(st, _times(_UP, _dot(st, _UP))))))
        stages.append(_stage("g3", "g2b", row=_v("flat"), col=_unit(_times(_cross(_v("flat"), _UP), "-1")), sp=f"cos(asin({_dot(_UP, away)}))", sr=f"cos(asin({_dot(_cross(_UP, sn), away)} / sqrt({_dot(_cross(away, _UP), _cross(away, _UP))})))"))
    axes = ", ".join(f"round({x}, 7) + 0.0 {x}" for x in [*_v("row"), *_v("col")])
    return ", ".join(stages) + (
        f", g4 as (select *, ceil((re/sp)*1.5::double/(rr/sp))::bigint n_rows, ceil((ce/sr)*1.5::double/(cr/sr))::bigint n_cols from g3)"
        f" select collect_id, {axes}, n_rows, n_cols, round(re/sp/n_rows, 6) row_spacing, round(ce/sr/n_cols, 6) col_spacing, round(0.886::double*rr, 6) row_width, round(0.886::double*cr, 6) col_width from g4"
    )


def _grid(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    k, own = F.col("collect_id"), _flights(spark, sf_dir)
    for a in "xyz":
        own = own.withColumns({f"centre_{a}": F.col(f"scp_{a}"), f"mid_{a}": F.col(f"arp_{a}"), f"first_{a}": F.col(f"arp_{a}") - F.col(f"vel_{a}"), f"last_{a}": F.col(f"arp_{a}") + F.col(f"vel_{a}")})
    own = own.withColumns({"range_extent": 400.3 + k % 13, "cross_extent": 300.3 + k % 11, "range_resolution": F.lit(0.5), "cross_resolution": 0.4 + (k % 3) * 0.1})
    out = algorithms.formation_grid(own, kind)
    axes = [rounded(F.col(f"{n}_{a}"), 7).alias(f"{n}_{a}") for n in ("row", "col") for a in "xyz"]
    return out.select("collect_id", *axes, "n_rows", "n_cols", *[F.round(x, 6).alias(x) for x in ("row_spacing", "col_spacing", "row_width", "col_width")])


@query(_grid_sql("slant"))
def slant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "slant")


@query(_grid_sql("ground"))
def ground_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "ground")


@query(
    f"with {FLIGHT}, t as (select *, (1 - (p_y*p_y)/(({A!r}::double+50)*({A!r}::double+50)) - p_z*p_z/((6356752.314245::double+50)*(6356752.314245::double+50))) q from (select *, collect_id % 300 * 1.0::double p_y, collect_id % 200 * 1.0::double p_z from fl))"
    f" select collect_id, round(({A!r}::double+50)*sqrt(q), 2) x, round(p_y, 2) + 0.0 y, round(p_z, 2) + 0.0 z from t"
)
def newton_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at 50 m are found again from their own range and range rate."""
    k = F.col("collect_id")
    a, b = A + 50.0, 6356752.314245 + 50.0
    own = _flights(spark, sf_dir).withColumns({"p_y": (k % 300) * 1.0, "p_z": (k % 200) * 1.0})
    own = own.withColumn("p_x", a * F.sqrt(1 - F.col("p_y") * F.col("p_y") / (a * a) - F.col("p_z") * F.col("p_z") / (b * b)))
    back = vec("p") - vec("arp")
    own = own.withColumn("range", back.norm()).withColumn("rate", -vec("vel").dot(back) / back.norm())
    out = algorithms.to_height_by_newton(own, 50.0)
    return out.select("collect_id", *[rounded(F.col(f"out_{x}"), 2).alias(x) for x in "xyz"])


@query(
    ", ".join([f"with {FLIGHT}", _stage("v1", "fl", los=_unit(_minus(_SCP, _ARP))), _stage("v2", "v1", slant=_times(_unit(_cross(_VEL, _v("los"))), f"sign({_dot(_cross(_ARP, _VEL), _v('los'))})")), _stage("v3", "v2", toward=_unit(_minus(_v("los"), _times(_UP, _dot(_v("los"), _UP)))), layover=_unit(_minus(_UP, _times(_v("slant"), f"(1 / {_dot(_UP, _v('slant'))})"))))])
    + " select collect_id, "
    + ", ".join(f"round({x}, 7) + 0.0 {x}" for n in ("slant", "toward", "layover") for x in _v(n))
    + " from v3"
)
def geometry_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = algorithms.geometry_vectors(_flights(spark, sf_dir))
    return out.select("collect_id", *[rounded(F.col(f"{n}_{a}"), 7).alias(f"{n}_{a}") for n in ("slant", "toward", "layover") for a in "xyz"])


@query(
    f"with {COLLECT} select collect_id, not (collect_id % 3 = 0 or side = 'R' and collect_id % 5 = 1 or collect_id % 4 = 2 or (collect_id % 7 = 0 and collect_id % 6 < 3)) normalized from co"
)
def normalized_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("collect_id")
    polynomial = F.when(k % 3 == 0, F.array(F.lit(0.0), F.lit(0.5))).when(k % 3 == 1, F.array(F.lit(0.0)))
    window = F.when((F.col("side") == "R") & (k % 5 == 1), "TAYLOR").when(k % 5 == 2, "UNIFORM")
    weights = F.when((k % 7 == 0) & (k % 6 < 3), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.5))).when(k % 7 == 1, F.array(F.lit(1.0), F.lit(1.0)))
    sign = F.when(k % 4 == 2, 1).when(k % 4 == 1, -1)
    return views.collects(spark, sf_dir).select("collect_id", algorithms.is_normalized(polynomial, window, weights, sign).alias("normalized"))


# Estimates

_ROIS = "roi as (select * from (values (0, 10, 60, 2, 12), (1, 40, 120, 8, 30), (2, 200, 480, 0, 31)) t(roi, r0, r1, c0, c1))"


@query(
    f"with {PX}, {_ROIS}, li as (select roi, r0, r1, r, sum(re*re+im*im) p from px join roi on r between r0 and r1 and c between c0 and c1 group by all),"
    " e as (select roi, sum(p) total, min(p) filter (r between r0+5 and r1-5) lo, max(p) filter (r between r0+5 and r1-5) hi from li group by 1)"
    " select roi, round(10*log10(total/(select min(total) from e)), 6) + 0.0 average, round(10*log10(lo/(select min(total) from e)), 6) + 0.0 least, round(10*log10(hi/(select min(total) from e)), 6) + 0.0 greatest from e"
)
def region_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.createDataFrame([(0, 10, 60, 2, 12), (1, 40, 120, 8, 30), (2, 200, 480, 0, 31)], "roi int, r0 long, r1 long, c0 long, c1 long")
    out = estimates.region_statistics(views.pixels(spark, sf_dir), regions, 5)
    return out.select("roi", *[rounded(F.col(x)).alias(x) for x in ("average", "least", "greatest")])


@query(
    f"with {PX}, t as (select r//50 tile_r, c//8 tile_c, 10*log10(avg(re*re+im*im)) m, (min(r)+max(r))/2.0::double mr, (min(c)+max(c))/2.0::double mc from px group by 1, 2)"
    " select tile_r, tile_c, round(m, 6) measured, round(-20 + 0.001::double*((mc-16)*3) + 0.01::double*((mr-250)*2) + 1e-5::double*((mr-250)*2)*((mc-16)*3), 6) predicted from t"
)
def noise_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefficients = F.array(F.array(F.lit(-20.0), F.lit(0.001)), F.array(F.lit(0.01), F.lit(1e-5)))
    out = estimates.noise(views.pixels(spark, sf_dir), 50, 8, coefficients, (2.0, 3.0), (250, 16))
    return out.select("tile_r", "tile_c", F.round("measured", 6).alias("measured"), F.round("predicted", 6).alias("predicted"))


_SUPPORT = f"{PX}, {dft_sql(SAMPLES)}, w as (select k, sum(sqrt(re*re+im*im)) w from ft group by 1), z as (select k j, w from w where k < 16 union all select k + 1 j, w from w where k >= 15)"


@query(
    f"with {_SUPPORT}, f as (select sum(w) f0, sqrt(pow(sum(w*cos(2*pi()*j/33)), 2) + pow(sum(w*sin(2*pi()*j/33)), 2)) f1 from z),"
    " g as (select j, w, (f0 + 2*f1*cos(2*pi()*j/33))/33 cosine from z, f), l as (select regr_slope(w, j) s, regr_intercept(w, j) i from z)"
    " select j, round(cosine/(select max(cosine) from g), 6) weight, (select sqrt(sum((cosine-w)*(cosine-w))) < sqrt(sum((i+s*j-w)*(i+s*j-w))) from g, l) cosine from g"
)
def weighting_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighting that the spectrum's sums over all lines show; one number for each bin reaches the driver."""
    rows = estimates.spectrum_weights(views.lines(spark, sf_dir)).orderBy("k").collect()
    is_cosine, fit = estimates.fitted_weights([x["weight"] for x in rows])
    values = [(k, float(np.round(x, 6)), is_cosine) for k, x in enumerate(fit)]
    return spark.createDataFrame(values, "j long, weight double, cosine boolean")


@query(f"with {PX} select round(avg(sqrt(re*re+im*im)), 8) mean from px where isfinite(re) and isfinite(im)")
def sampled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than 1000 x 1000 places are all taken; tall images give every second line and so on."""
    px = views.pixels(spark, sf_dir)
    return estimates.sampled_mean(px, views.height(spark, sf_dir), SAMPLES, most=1_000_000).select(F.round("mean", 8).alias("mean"))


@query(
    f"with {PX}, u as (select range k, range*0.75::double place from range(40)), s as (select r, k, re, im, case when abs(place-c) < 1e-12 then 1 else sin(pi()*(place-c))/(pi()*(place-c)) end w from px, u)"
    " select r, k c, round(sum(re*w), 6) + 0.0 re, round(sum(im*w), 6) + 0.0 im from s group by 1, 2"
)
def sinc_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.spectral import unpacked

    out = unpacked(estimates.sinc_interpolated(views.lines(spark, sf_dir), np.arange(40) * 0.75))
    return out.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


@query(
    "with e as (select user_id, lead(epoch_us(ts)) over (partition by user_id order by event_id) - epoch_us(ts) step from events)"
    " select user_id platform_id, min(step) least, max(step) greatest, count(*) filter (step <= 0) backward from e group by 1"
)
def time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("platform_id"), F.col("event_id").alias("place"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return estimates.gaps(rows, "platform_id", "t")


@query(
    f"with {COLLECT}, s as (select collector, side, count(*) n from co group by 1, 2), m as (select collector, arg_max(side, n*1000 - ascii(side)) side from s group by 1)"
    " select collector, side, (select count(distinct pol) from co where co.collector = m.collector)::int polarisations from m"
)
def collector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates.collector_summary(views.collects(spark, sf_dir))


_FIELDS = "list_filter(['graze', case when collect_id%2=0 then 'side' end, case when collect_id%3=0 then 'pol' end, case when collect_id%5=0 then 'own_note' end], lambda x: x is not null)"


@query(
    f"with {COLLECT}, p as (select collect_id, {_FIELDS} f from co) select collect_id, array_to_string(list_sort(list_filter(['graze', 'pol', 'side'], lambda x: list_contains(f, x))), ',') known,"
    " array_to_string(list_sort(list_filter(['graze', 'pol', 'side'], lambda x: not list_contains(f, x))), ',') missing, array_to_string(list_sort(list_filter(f, lambda x: not list_contains(['graze', 'pol', 'side'], x))), ',') unknown from p"
)
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("collect_id")
    present = F.array_compact(F.array(F.lit("graze"), F.when(k % 2 == 0, "side"), F.when(k % 3 == 0, "pol"), F.when(k % 5 == 0, "own_note")))
    out = estimates.field_differences(present, ["graze", "side", "pol"])
    return views.collects(spark, sf_dir).select("collect_id", *[v.alias(n) for n, v in out.items()])


@query(f"with {COLLECT} select collect_id, collector, lat, lon, graze from co")
def visible_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    config = json.loads('{"collect_start": false, "hae": false, "azim": false, "side": false, "pol": false, "graze": true}')
    return estimates.visible_fields(views.collects(spark, sf_dir), config)


@query(
    "select event_id, (epoch_us(ts) // 1000000)::bigint whole, round(((epoch_us(ts) % 1000000) * 1000 + event_id % 1000) / 1e9::double, 9) rest from events"
)
def split_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with nanoseconds, which a timestamp would cut."""
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z"))
    whole, rest = estimates.split_time(text)
    return views.table(spark, sf_dir, "events").select("event_id", whole.alias("whole"), F.round(rest, 9).alias("rest"))


@query("select l_orderkey, count(*)::int lines from lineitem group by 1")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a document for each order, counted by path."""
    rows = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.format_string('<line n="%d">%s</line>', "l_linenumber", "l_returnflag")), "").alias("body"))
    xml = F.concat(F.lit("<order>"), F.col("body"), F.lit("</order>"))
    return rows.select("l_orderkey", estimates.node_count(xml, "/order/line").alias("lines"))


@query(f"with {COLLECT} select collect_id, round(graze, 4) tx_angle, round(azim, 4) rcv_angle, round(-graze, 4) tx_ellipticity, 0.5::double rcv_ellipticity from co")
def decomposition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("TxAngle=%.4f\nRcvAngle=%.4f\nTxEll=%.4f\nRcvEll=0.5", "graze", "azim", -F.col("graze"))
    out = estimates.decomposition(text, ("tx_angle", "rcv_angle", "tx_ellipticity", "rcv_ellipticity"))
    return views.collects(spark, sf_dir).select("collect_id", *[v.alias(n) for n, v in out.items()])


@query(f"with {PX} select r, c, round(re, 6) + 0.0 re from px where (r >= 20 and r < 60 and c >= 4 and c < 12) or (r >= 40 and r < 200 and c >= 10 and c < 30)")
def polygon_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = estimates.any_polygon(F.col("r"), F.col("c"), [[(20, 4), (20, 12), (60, 12), (60, 4)], [(40, 10), (40, 30), (200, 30), (200, 10)]])
    return views.pixels(spark, sf_dir).where(inside).select("r", "c", rounded(F.col("re")).alias("re"))


@query(
    f"with {BANDS} select r, c, round(sqrt(pow(hh_re-vv_re, 2)+pow(hh_im-vv_im, 2)), 6) red, round(sqrt(pow(hv_re+vh_re, 2)+pow(hv_im+vh_im, 2))/2, 6) green, round(sqrt(pow(hh_re+vv_re, 2)+pow(hh_im+vv_im, 2)), 6) blue from bd"
)
def viewer_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = estimates.viewer_bands(views.bands(spark, sf_dir))
    return out.select("r", "c", *[F.round(x, 6).alias(x) for x in ("red", "green", "blue")])
