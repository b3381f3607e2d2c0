"""Queries over image grids, axes and apertures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy
from ..functions.cx import rounded
from ..operators import grids, measures, spectral
from . import views
from .pixels import dft_sql
from .views import COLLECT, HEIGHT, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

ARP = ([7000000.0, 3.0], [-1000.0, 7500.0], [500000.0, 10.0])
BASE = dict(scp=(geodesy.SEMI_MAJOR, 0.0, 0.0), arp=ARP, coa_time=[[0.1, 1e-6], [1e-6]], row_spacing=2.0, col_spacing=3.0, scp_row=10, scp_col=16, row=(0.0, 0.0, -1.0), col=(0.0, 1.0, 0.0))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_A = f"{geodesy.SEMI_MAJOR!r}::double"
LATTICE = (
    f"{PX}, la as (select r, c, (r-10)*2.0::double u, (c-16)*3.0::double v from px),"
    " tc as (select *, 0.1::double+1e-6*v+1e-6*u t from la),"
    f" ps as (select *, 7000000.0::double+3*t-{_A} bx, -1000.0::double+7500*t by_, 500000.0::double+10*t bz from tc),"
    " rr as (select *, sqrt(bx*bx+by_*by_+bz*bz) r0, (3*bx+7500*by_+10*bz)/sqrt(bx*bx+by_*by_+bz*bz) v0 from ps)"
)


def _contours(spark: SparkSession, sf_dir: str, **changes) -> DataFrame:
    """Contours of every pixel of the test image."""
    px = views.pixels(spark, sf_dir).select("r", "c")
    out = grids.with_contours(px, grids.Grid(**{"kind": "PLANE", **BASE, **changes}))
    return out.select("r", "c", rounded(F.col("range"), 3).alias("range"), rounded(F.col("rate"), 4).alias("rate"))


@query(
    f"with {LATTICE}, pl as (select r, c, bx x, by_-v y, bz+u z from rr) select r, c, round(sqrt(x*x+y*y+z*z), 3) \"range\", round((3*x+7500*y+10*z)/sqrt(x*x+y*y+z*z), 4) + 0.0 rate from pl"
)
def contour_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contours(spark, sf_dir)


@query(f"with {LATTICE} select r, c, round(r0+u, 3) \"range\", round(v0-sqrt(9.0::double+7500*7500+100)*1e-6*v, 4) + 0.0 rate from rr")
def contour_rgazcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contours(spark, sf_dir, kind="RGAZIM", algorithm="RGAZCOMP", azimuth_scale=1e-6)


@query(
    f"with {LATTICE}, pa as (select *, 0.01::double*t th from rr), pk as (select *, 1+0.002::double*th+0.1::double*th*th k, 0.002::double+0.2::double*th dk, u*cos(th)+v*sin(th) al, v*cos(th)-u*sin(th) ac from pa)"
    ' select r, c, round(r0+k*al, 3) "range", round(v0+(dk*al+k*ac)*0.01::double, 4) + 0.0 rate from pk'
)
def contour_pfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contours(spark, sf_dir, kind="RGAZIM", algorithm="PFA", polar_angle=[0.0, 0.01], frequency_scale=[1.0, 0.002, 0.1])


@query(
    f"with {LATTICE}, rz as (select *, t-1e-4*v dt, 9.0::double+7500*7500+100 v2 from tc), rq as (select *, sqrt((800000.0::double+u)*(800000.0::double+u)+v2*dt*dt) q from rz)"
    ' select r, c, round(q, 3) "range", round(v2*dt/q, 4) + 0.0 rate from rq'
)
def contour_rgzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contours(spark, sf_dir, kind="RGZERO", approach_time=[0.0, 1e-4], approach_range=800_000.0, doppler_rate_scale=[[1.0]])


@query()
def dem_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels on a slope: the height found is the slope's at the place found."""
    dem = spark.range(-2, 3).select(F.col("id").alias("ilat")).join(spark.range(-2, 3).select(F.col("id").alias("ilon"))).withColumn("elev", 100.0 + 50.0 * F.col("ilat"))
    px = views.pixels(spark, sf_dir).select("r", "c")
    out = grids.to_terrain(px, grids.Grid(kind="PLANE", **BASE), dem, 1.0, 0.0, 200.0, spacing=400.0)
    return out.select("r", "c", rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("lon"), 6).alias("lon"), rounded(F.col("height"), 2).alias("height"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bin for each line of the test image."""
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"))


@query(f"with {HEIGHT} select vec_id k, round(((64.0::double*{geodesy.LIGHT!r}::double/2 - {geodesy.LIGHT!r}::double/2.0::double) + {geodesy.LIGHT!r}::double/1.0::double*vec_id/(height-1))/1e9, 8) gigahertz from embeddings, he")
def rcs_fast_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.fast_time_axis(_bins(spark, sf_dir), 64.0, 0.5, views.height(spark, sf_dir)).select("k", rounded(F.col("gigahertz"), 8).alias("gigahertz"))


@query(f"with {HEIGHT}, k as (select vec_id k, vec_id/(height-1)::double p from embeddings, he) select k, round((-(p-0.5)*1.25::double+0.5)*10, 6) + 0.0 \"seconds\", round(-(p-0.5)*(1.25::double*4), 6) + 0.0 polar_angle, round(((-(p-0.5)*(1.25::double*4)+30+360)%360+360)%360, 6) azimuth from k")
def rcs_slow_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.slow_time_axis(_bins(spark, sf_dir), views.height(spark, sf_dir), 10.0, 4.0, 30.0, 1.25, left=True)
    return out.select("k", *[rounded(F.col(x)).alias(x) for x in ("seconds", "polar_angle", "azimuth")])


@query(f"with {COLLECT} select collect_id, round(0.02::double*(8e5::double+collect_id)/(7500*sin(radians(60+graze))), 6) \"seconds\" from co")
def collect_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = measures.collect_duration(F.lit(0.02), 8e5 + F.col("collect_id"), F.lit(7500.0), 60 + F.col("graze"))
    return views.collects(spark, sf_dir).select("collect_id", rounded(seconds).alias("seconds"))


@query(f"with {PX} select r, c, round(re*(0.54::double+0.46::double*cos(pi()*(-1+2.0::double*c/31))), 6) + 0.0 re, round(im*(0.54::double+0.46::double*cos(pi()*(-1+2.0::double*c/31))), 6) + 0.0 im from px")
def aperture_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measures.weighted_aperture(views.pixels(spark, sf_dir), "HAMMING", views.height(spark, sf_dir), SAMPLES, rows=False)
    return out.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


@query(
    f"with {PX}, {dft_sql(SAMPLES)}, mv as (select r, case when k < 16 then k else k+32 end c, re*2 re, im*2 im from ft), {dft_sql(2 * SAMPLES, True, 'mv', 'bk')}"
    " select r, k c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from bk"
)
def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.unpacked(spectral.upsampled(views.lines(spark, sf_dir), 2 * SAMPLES))
    return out.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


_I0 = "(select sum(pow({x}/2, 2*m)/(factorial(m::int)::double*factorial(m::int)::double)) from range(25) b(m))"
_KAISER = "w as (select k, " + _I0.format(x="(5*sqrt(greatest(0, 1-pow(2.0::double*k/30-1, 2))))") + "/" + _I0.format(x="5.0::double") + " v from range(31) t(k))"


@query(
    f"with {PX}, {_KAISER}, t as (select r, b.k bin, sum(v*(re*cos(-2*pi()*((b.k*c)%32)/32)-im*sin(-2*pi()*((b.k*c)%32)/32))) x, sum(v*(re*sin(-2*pi()*((b.k*c)%32)/32)+im*cos(-2*pi()*((b.k*c)%32)/32))) y"
    " from px join w on w.k = c, range(32) b(k) group by 1, 2) select r, 0::bigint frame, (bin+16)%32 bin, round(10*log10(x*x+y*y+1e-30::double), 5) + 0.0 db from t"
)
def spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectrogram(views.lines(spark, sf_dir)).select("r", "frame", "bin", rounded(F.col("db"), 5).alias("db"))


@query(
    f"with {PX}, {HEIGHT}, s as (select r, c, re, im, sum(re) over w sr, sum(im) over w si from px window w as (partition by c order by r rows between 1 preceding and 1 following))"
    " select r, c, round(case when r in (0, height-1) then re else sr end, 6) + 0.0 re, round(case when r in (0, height-1) then im else si end, 6) + 0.0 im from s, he"
)
def block_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function of blocks with halos: a moving sum of three lines."""
    height = views.height(spark, sf_dir)

    def kernel(z):
        out = z.copy()
        out[1:-1] = z[:-2] + z[1:-1] + z[2:]
        return out

    return measures.by_blocks(views.pixels(spark, sf_dir), 64, 2, kernel, height).select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


# Metadata of images, some of them wrong, made from the catalog. The text is the same for
# both engines.
_K = "collect_id"
METADATA = [
    f"{value} as {name}"
    for name, value in {
        "mode": f"case when {_K} % 3 = 0 then 'SPOTLIGHT' else 'STRIPMAP' end",
        "coa_scalar": f"{_K} % 5 <> 0",
        "row_sgn": "-1",
        "col_sgn": f"case when {_K} % 11 = 0 then 1 else -1 end",
        **{f"{a}_ss": "cast(0.5 as double)" for a in ("row", "col")},
        "row_dk1": f"cast({_K} % 7 as double) / -5",
        "row_dk2": "cast(0.8 as double)",
        "row_bw": "cast(1.5 as double)",
        "col_dk1": "cast(-0.7 as double)",
        "col_dk2": f"cast({_K} % 4 as double) / 2 - 0.75",
        "col_bw": "cast(1.0 as double)",
        "row_window": f"case {_K} % 4 when 0 then 'UNIFORM' when 1 then 'TAYLOR' when 2 then 'ODD' end",
        "row_weight_count": f"case when {_K} % 2 = 0 then {_K} % 2000 end",
        "row_width": "cast(0.6 as double)",
        "row_broadening": "cast(0.9 as double)",
        "arp_terms": f"{_K} % 6",
        "scp_time": f"cast({_K} % 10 as double)",
        "coa_constant": f"cast({_K} % 9 as double)",
        "duration": "cast(9.0 as double)",
        "side": "side",
        "derived_side": "'L'",
        "graze": "graze",
        "derived_graze": "cast(40.0 as double)",
        "tx_bandwidth": "cast(1e8 as double)",
        "tx_length": "cast(1e-5 as double)",
        "tx_rate": f"cast(1e13 as double) * ({_K} % 2 + 1)",
        "demodulation": f"case when {_K} % 2 = 0 then 'CHIRP' else 'STRETCH' end",
        "rcv_rate": f"cast(1e13 as double) * ({_K} % 3)",
        "valid_pixels": f"case when {_K} % 8 > 2 then 1 end",
        "valid_geo": f"case when {_K} % 8 > 4 then 1 end",
        "algorithm": f"case {_K} % 4 when 0 then 'PFA' when 1 then 'RGAZCOMP' when 2 then 'RMA' else 'OTHER' end",
        "grid": f"case when {_K} % 5 < 3 then 'RGAZIM' else 'RGZERO' end",
        "plane": f"case when {_K} % 7 < 5 then 'SLANT' else 'GROUND' end",
        "polar_reference": f"case when {_K} % 8 <> 4 then cast({_K} % 10 as double) end",
        "rma_kind": f"case {_K} % 12 when 2 then 'INCA' when 6 then 'RMAT' end",
        "col_kctr": f"cast({_K} % 13 as double) / 100",
        "has_doppler": f"{_K} % 5 < 2",
        "noise_kind": f"case {_K} % 3 when 0 then 'ABSOLUTE' when 1 then 'RELATIVE' end",
        "noise_constant": f"cast({_K} % 2 as double)",
        "reference_index": f"case when {_K} % 100 = 0 then 1 end",
        "proc_polarisation": "pol",
        "all_polarisations": "'H:H H:V V:V'",
    }.items()
]


#: What is wrong with the catalog's metadata above, worked out by hand from each rule's
#: meaning: rule, level, and the collections k that break it.
WRONG = [
    ("spotlight_coa", "Error", "k % 3 = 0 and k % 5 = 0"),
    ("moving_coa", "Warning", "k % 3 <> 0 and k % 5 <> 0"),
    ("sgn", "Error", "k % 11 = 0"),
    ("row_dk1", "Error", "k % 7 = 6"),
    ("row_bw", "Error", "k % 7 <= 3"),
    ("row_weights", "Warning", "k % 4 = 1"),
    ("row_window", "Style", "k % 4 = 2"),
    ("row_long_weights", "Style", "k % 2 = 0 and k % 2000 > 1024"),
    ("col_dk_order", "Error", "k % 4 = 0"),
    ("col_bw", "Error", "k % 4 <= 2"),
    ("arp_terms", "Error", "k % 6 < 2"),
    ("scp_time", "Error", "k % 10 <> k % 9"),
    ("side", "Error", "k % 2 = 1"),
    ("graze", "Error", "k % 50 <> 20"),
    ("tx_bandwidth", "Error", "k % 2 = 1"),
    ("chirp", "Error", "k % 2 = 0 and k % 3 <> 0"),
    ("stretch", "Warning", "k % 2 = 1 and k % 3 <> 2"),
    ("valid_data", "Error", "k % 8 in (3, 4)"),
    ("rgazcomp_plane", "Error", "k % 4 = 1 and k % 7 >= 5"),
    ("rgazcomp_grid", "Error", "k % 4 = 1 and k % 5 >= 3"),
    ("pfa_grid", "Error", "k % 4 = 0 and k % 5 >= 3"),
    ("pfa_block", "Error", "k % 8 = 4"),
    ("rma_kind", "Error", "k % 12 = 10"),
    ("rma_rmat_grid", "Error", "k % 12 = 6"),
    ("inca_grid", "Error", "k % 12 = 2 and k % 5 < 3"),
    ("inca_centre", "Error", "k % 12 = 2 and k % 13 <> 0"),
    ("inca_doppler", "Error", "k % 12 = 2 and k % 5 >= 2"),
    ("other_algorithm", "Warning", "k % 4 = 3"),
    ("processed_polarisation", "Error", "k % 4 = 2"),
    ("scp_middle", "Warning", "k % 10 <= 2 or k % 10 >= 7"),
    ("relative_noise", "Error", "k % 6 = 1"),
    ("noise_absolute", "Optional", "k % 3 <> 0"),
    ("reference_frequency", "Optional", "k % 100 = 0"),
    ("valid_missing", "Optional", "k % 8 <= 2"),
]


def _validation_sql() -> str:
    return "with co as (select o_orderkey k from orders join customer on o_custkey = c_custkey) " + " union all ".join(f"select k collect_id, '{n}' rule, '{level}' \"level\" from co where {c}" for n, level, c in WRONG)


@query(_validation_sql())
def validate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.validation import validate

    rows = views.collects(spark, sf_dir).selectExpr("collect_id", *METADATA)
    return validate(rows, "collect_id").select("collect_id", "rule", "level")
