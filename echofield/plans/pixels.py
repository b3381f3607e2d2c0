"""Queries over pixels, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import rounded
from ..operators import change, display, filters, polarimetry, raster, spectral
from . import views
from .views import BANDS, HEIGHT, PAIR, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[rounded(F.col(v), digits).alias(v) for v in values])


def box(source: str, columns: list[str], half: int, prefix: str = "", others: str = "") -> str:
    """SQL for separable window sums: two common table expressions, the last is ``box``."""
    down = ", ".join(f"sum({x}) over w {x}" for x in columns)
    return (
        f"{prefix}down as (select r, c{others}, {down} from {source} window w as (partition by c order by r range between {half} preceding and {half} following)),"
        f" {prefix}box as (select r, c{others}, {down} from {prefix}down window w as (partition by r order by c range between {half} preceding and {half} following))"
    )


PRODUCTS = "prod as (select r, c, ar*br+ai*bi xr, ar*bi-ai*br xi, ar*ar+ai*ai pa, br*br+bi*bi pb from pr)"
SUMS = f"with {PAIR}, {PRODUCTS}, {box('prod', ['xr', 'xi', 'pa', 'pb'], 2)} "


@query(SUMS + "select r, c, round(case when pa*pb > 0 then sqrt(xr*xr+xi*xi)/sqrt(pa*pb) else 0 end, 6) + 0.0 coherence from box")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(change.coherence(views.image_pair(spark, sf_dir)), ["r", "c"], ["coherence"])


@query(
    SUMS + ", v as (select r, c, 2*sqrt(xr*xr+xi*xi)/(pa+pb-25*(0.1::double+0.2::double)) x from box)"
    " select r, c, round(case when x between 0 and 1 then x else 1 end, 6) + 0.0 coherence from v"
)
def coherence_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(change.noise_aware_coherence(views.image_pair(spark, sf_dir), 0.1, 0.2), ["r", "c"], ["coherence"])


@query(
    SUMS + ", v as (select r, c, xr, pa/50 - 0.001::double a, pb/50 - 0.002::double b from box)"
    " select r, c, round(case when a > 0 and b > 0 then 2*xr/(100*sqrt(abs(a*b))) else -100 end, 6) + 0.0 correlation from v"
)
def sccm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(change.signal_correlation(views.image_pair(spark, sf_dir), 0.001, 0.002), ["r", "c"], ["correlation"])


@query(f"with {PAIR} select r, c, round(sqrt(ar*ar+ai*ai), 6) red, round(sqrt(br*br+bi*bi), 6) green, round(sqrt(br*br+bi*bi), 6) blue from pr")
def amplitude_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(change.amplitude_change(views.image_pair(spark, sf_dir)), ["r", "c"], ["red", "green", "blue"])


@query(f"with {PX} select r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px where r between 100 and 199 and c between 4 and 27 and (r-100)%3=0 and (c-4)%2=0")
def aoi_stride_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.area(views.pixels(spark, sf_dir), (100, 199), (4, 27), (3, 2)), ["r", "c"], ["re", "im"])


@query(f"with {PX} select r-100 r, c-4 c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px where r between 100 and 199 and c between 4 and 27")
def subset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.subset(views.pixels(spark, sf_dir), (100, 199), (4, 27)), ["r", "c"], ["re", "im"])


@query(f"with {PX} select r//4 r, c//4 c, round(max(sqrt(re*re+im*im)), 6) amplitude from px group by 1, 2")
def decimate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.decimated(views.pixels(spark, sf_dir), 4, 4), ["r", "c"], ["amplitude"])


@query(f"with {PX} select r//4 r, c//4 c, round(avg(sqrt(re*re+im*im)), 6) amplitude from px group by 1, 2")
def decimate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.decimated(views.pixels(spark, sf_dir), 4, 4, F.avg), ["r", "c"], ["amplitude"])


@query(f"with {PX}, {HEIGHT} select {SAMPLES - 1}-c r, height-1-r c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px, he")
def flip_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    return _rounded(raster.oriented(px, views.height(spark, sf_dir), SAMPLES, True, True, True), ["r", "c"], ["re", "im"])


@query(f"with {PX} select r // 2 r, c, (r % 2)::int band, round(re, 6) + 0.0 re from px")
def band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd lines as two bands; both images have the same size if the lines are even in number."""
    px = views.pixels(spark, sf_dir)
    first = px.where("r % 2 = 0").withColumn("r", F.expr("r div 2"))
    second = px.where("r % 2 = 1").withColumn("r", F.expr("r div 2"))
    return raster.stacked([first, second]).select("r", "c", "band", rounded(F.col("re")).alias("re"))


@query(f"with {PX}, {HEIGHT} select case when r < height // 2 then r else r + 50 end r, c, round(im, 6) + 0.0 im from px, he")
def segment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the lines, with a gap of 50 between."""
    px, half = views.pixels(spark, sf_dir), views.height(spark, sf_dir) // 2
    first, second = px.where(F.col("r") < half), px.where(F.col("r") >= half).withColumn("r", F.col("r") - half)
    return _rounded(raster.segments([(first, 0), (second, half + 50)]), ["r", "c"], ["im"])


@query(f"with {PX}, {box('px', ['re', 'im'], 2)} select r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from box")
def boxcar_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.window_sums(views.pixels(spark, sf_dir), ["re", "im"], 2, 2), ["r", "c"], ["re", "im"])


@query(f"with {PX} select r, c, round(sum(re) over (partition by c order by r rows between 20 preceding and 20 following), 6) + 0.0 re from px")
def local_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.prefix_window_sums(views.pixels(spark, sf_dir), "re", 20, views.height(spark, sf_dir)), ["r", "c"], ["re"])


@query(f"with {PX}, {box('px', ['re'], 1)} select r, c, round(re/9, 6) + 0.0 re from box")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    return _rounded(raster.running_mean(px, "re", 1, 1, views.height(spark, sf_dir), SAMPLES), ["r", "c"], ["re"])


@query(f"with {PX} select r, c, round(re, 6) + 0.0 re, true inside from px where r >= 50 and r < 150 and c >= 8 and c < 24")
def valid_data_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = raster.in_polygon(F.col("r"), F.col("c"), [(50, 8), (50, 24), (150, 24), (150, 8)])
    return views.pixels(spark, sf_dir).where(inside).select("r", "c", rounded(F.col("re")).alias("re"), F.lit(True).alias("inside"))


LOCAL = (
    f"with {PX}, pw as (select r, c, re*re+im*im i, (re*re+im*im)*(re*re+im*im) q, 1.0::double n, re*re+im*im own from px), "
    + box("pw", ["i", "q", "n"], 2, others=", own")
    + ", st as (select r, c, own i, i s, i/n mean, greatest(0, q/n - (i/n)*(i/n)) var from box),"
    " lo as (select *, case when mean > 0 then var/(mean*mean) else 0 end k from st) "
)


def _speckle(value: str) -> str:
    return LOCAL + f", f as (select r, c, i, {value} v from lo), m as (select avg(i)/avg(v) g from f) select r, c, round(sqrt(greatest(v*g, 0)), 5) + 0.0 amplitude from f, m"


@query(_speckle("s/25"))
def speckle_boxcar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.speckle(views.pixels(spark, sf_dir), "boxcar"), ["r", "c"], ["amplitude"], 5)


@query(_speckle("mean + (i-mean)*least(1, greatest(k-0.5::double, 1e-20)/greatest(k, 1e-20))"))
def speckle_lee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.speckle(views.pixels(spark, sf_dir), "lee", n_looks=2.0), ["r", "c"], ["amplitude"], 5)


@query(_speckle("mean + (i-mean)*least(1, greatest((k-0.5::double)/1.5::double, 1e-20)/greatest(k, 1e-20))"))
def speckle_kuan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.speckle(views.pixels(spark, sf_dir), "kuan", n_looks=2.0), ["r", "c"], ["amplitude"], 5)


_T = "greatest((k-0.5::double)/1.5::double, 1e-20)"
_B = f"(mean/{_T} - 3)"


@query(_speckle(f"case when k >= 0.5 and {_T} <= 1.0::double/3 then ({_B} + sqrt({_B}*{_B} + 8*i*mean/{_T}))*{_T}/2 else i end"))
def speckle_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.speckle(views.pixels(spark, sf_dir), "map", n_looks=2.0), ["r", "c"], ["amplitude"], 5)


@query(
    LOCAL + ", nb as (select p.r + a r, p.c + b c, a, b, i from (select r, c, re*re+im*im i from px) p, range(-2, 3) x(a), range(-2, 3) y(b)),"
    " fr as (select lo.r, lo.c, lo.i, sum(exp(-k*sqrt((a*a+b*b)::double))*nb.i)/sum(exp(-k*sqrt((a*a+b*b)::double))) v from nb join lo on nb.r=lo.r and nb.c=lo.c group by 1, 2, 3),"
    " m as (select avg(i)/avg(v) g from fr) select r, c, round(sqrt(greatest(v*g, 0)), 5) + 0.0 amplitude from fr, m"
)
def speckle_frost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.frost(views.lines(spark, sf_dir), radius=2), ["r", "c"], ["amplitude"], 5)


@query(
    LOCAL + ", ra as (select ceil(-ln(0.01::double)/(sqrt(2.0::double)*20*min(k)))::bigint radius from lo), px_i as (select r, c, re*re+im*im i from px),"
    " nb as (select p.r + a r, p.c + b c, a, b, i from px_i p, ra, range(-60, 61) x(a), range(-31, 32) y(b) where abs(a) <= radius and abs(b) <= radius),"
    " fr as (select lo.r, lo.c, lo.i, sum(exp(-20*k*sqrt((a*a+b*b)::double))*nb.i)/sum(exp(-20*k*sqrt((a*a+b*b)::double))) v from nb join lo on nb.r=lo.r and nb.c=lo.c group by 1, 2, 3),"
    " m as (select avg(i)/avg(v) g from fr) select r, c, round(sqrt(greatest(v*g, 0)), 5) + 0.0 amplitude from fr, m"
)
def speckle_frost_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius follows from the most even window."""
    return _rounded(filters.frost(views.lines(spark, sf_dir), damping=20.0), ["r", "c"], ["amplitude"], 5)


def _sva(p: str) -> str:
    out = f"case when d{p} is null or ({p}+h{p}/2)*{p} < 0 or ({p}+v{p}/2)*{p} < 0 or ({p}+v{p}/2+h{p}/2+d{p}/4)*{p} < 0 then 0 else "
    out += f"(list_sort([struct_pack(a := abs({p}), k := 0, v := {p}), struct_pack(a := abs({p}+h{p}/2), k := 1, v := {p}+h{p}/2), struct_pack(a := abs({p}+v{p}/2), k := 2, v := {p}+v{p}/2),"
    out += f" struct_pack(a := abs({p}+v{p}/2+h{p}/2+d{p}/4), k := 3, v := {p}+v{p}/2+h{p}/2+d{p}/4)])[1]).v end"
    return out


@query(
    f"with {PX}, a as (select r, c, re, im, lag(re) over w + lead(re) over w vre, lag(im) over w + lead(im) over w vim from px window w as (partition by c order by r)),"
    " b as (select *, lag(re) over w + lead(re) over w hre, lag(im) over w + lead(im) over w him, lag(vre) over w + lead(vre) over w dre, lag(vim) over w + lead(vim) over w dim from a window w as (partition by r order by c))"
    f" select r, c, round({_sva('re')}, 6) + 0.0 re, round({_sva('im')}, 6) + 0.0 im from b"
)
def sva_apodize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.apodised(views.pixels(spark, sf_dir)), ["r", "c"], ["re", "im"])


def dft_sql(n: int, inverse: bool = False, source: str = "px", name: str = "ft") -> str:
    sign = 1 if inverse else -1
    scale = f"/{n}" if inverse else ""
    angle = f"({sign}*2*pi()/{n})*((k*c)%{n})"
    return f"{name} as (select r, k, sum(re*cos({angle})-im*sin({angle})){scale} re, sum(re*sin({angle})+im*cos({angle})){scale} im from {source}, range({n}) b(k) group by 1, 2)"


def dft_columns(source: str, name: str, inverse: bool = False) -> str:
    """As dft_sql, for as many samples as the image has lines."""
    angle = f"({'1' if inverse else '-1'}*2*pi()/height)*((k*c)%height)"
    scale = "/max(height)" if inverse else ""
    return f"{name} as (select r, k, sum(re*cos({angle})-im*sin({angle})){scale} re, sum(re*sin({angle})+im*cos({angle})){scale} im from {source}, he, range(0, (select height from he)) b(k) group by 1, 2)"


@query(f"with {PX}, {dft_sql(SAMPLES)} select r, k, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im from ft")
def dft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.relational(views.pixels(spark, sf_dir), SAMPLES), ["r", "k"], ["re", "im"], 5)


@query(f"with {PX}, {dft_sql(SAMPLES)} select r, k c, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im from ft")
def fft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.unpacked(spectral.transformed(views.lines(spark, sf_dir))), ["r", "c"], ["re", "im"], 5)


_RAMP = "((k+16)%32-16)*pi()*0.25::double/32"
_BACK = "(2*pi()/32)*((k*c)%32)"
_PDV = (
    f"with {PX}, {dft_sql(SAMPLES)}, sh as (select r, c, sum(re*cos({_BACK}-{_RAMP})-im*sin({_BACK}-{_RAMP}))/32 ar, sum(re*sin({_BACK}-{_RAMP})+im*cos({_BACK}-{_RAMP}))/32 ai,"
    f" sum(re*cos({_BACK}+{_RAMP})-im*sin({_BACK}+{_RAMP}))/32 br, sum(re*sin({_BACK}+{_RAMP})+im*cos({_BACK}+{_RAMP}))/32 bi from ft, range(32) t(c) group by 1, 2),"
    " xp as (select r, c, ar*br+ai*bi xr, ai*br-ar*bi xi from sh)"
)


@query(_PDV + ", " + box("xp", ["xr", "xi"], 2) + " select r, c, round(atan2(xi, xr)/0.25::double, 4) + 0.0 gradient from box")
def pdv_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.phase_gradient(views.lines(spark, sf_dir)), ["r", "c"], ["gradient"], 4)


@query(
    _PDV + ", nb as (select r + a r, c + b c, xr, xi from xp, range(-1, 2) x(a), range(-1, 2) y(b)),"
    " g as (select r, c, list_concat(list(xr), list_resize([]::double[], 9 - count(*), 0.0::double)) xr, list_concat(list(xi), list_resize([]::double[], 9 - count(*), 0.0::double)) xi from nb group by 1, 2)"
    " select g.r, g.c, round(atan2(list_sort(g.xi)[5], list_sort(g.xr)[5])/0.25::double, 4) + 0.0 gradient from g join px using (r, c)"
)
def pdv_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filters.phase_gradient_median(views.lines(spark, sf_dir)), ["r", "c"], ["gradient"], 4)


@query(f"with {PX}, {dft_sql(2 * SAMPLES, True)} select r, k, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from ft")
def idft_zeropad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.relational(views.pixels(spark, sf_dir), SAMPLES, True, 2 * SAMPLES), ["r", "k"], ["re", "im"])


@query(
    f"with {PX}, {HEIGHT}, {dft_sql(SAMPLES, name='f1')}, tr as (select k r, r c, re, im from f1), {dft_columns('tr', 'f2')}"
    " select (k+height//2)%height r, (r+16)%32 c, round(re, 4) + 0.0 re, round(im, 4) + 0.0 im from f2, he"
)
def fft2_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.unpacked(spectral.transformed_2d(views.lines(spark, sf_dir))), ["r", "c"], ["re", "im"], 4)


@query(
    f"with {PX}, ph as (select *, 2*pi()*(-1)*(0.1::double*x + 0.05::double/2*x*x) p from (select *, (c-16)*0.5::double x from px))"
    " select r, c, round(re*cos(p)-im*sin(p), 6) + 0.0 re, round(re*sin(p)+im*cos(p), 6) + 0.0 im from ph"
)
def deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.deskewed(views.pixels(spark, sf_dir), [0.1, 0.05], -1, 0.5, 16), ["r", "c"], ["re", "im"])


_HAMMING = "(0.54::double - 0.46::double*cos(2*pi()*((k+16)%32)/31))"


@query(
    f"with {PX}, {dft_sql(SAMPLES)}, dw as (select r, k c, re/{_HAMMING} re, im/{_HAMMING} im from ft), {dft_sql(SAMPLES, True, 'dw', 'bk')} select r, k c, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im from bk"
)
def deweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.unpacked(spectral.deweighted(views.lines(spark, sf_dir), "HAMMING")), ["r", "c"], ["re", "im"], 5)


@query(
    f"with {PX}, ph as (select r, c, re*cos(p)-im*sin(p) re, -(re*sin(p)+im*cos(p)) im from (select *, 2*pi()*(0.1::double*((c-16)*0.5::double)) p from px)),"
    f" {dft_sql(SAMPLES, source='ph')}, dw as (select r, k c, re/{_HAMMING} re, im/{_HAMMING} im from ft), {dft_sql(SAMPLES, True, 'dw', 'bk')} select r, k c, round(re, 5) + 0.0 re, round(im, 5) + 0.0 im from bk"
)
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.normalised(views.pixels(spark, sf_dir), [0.1], 1, 0.5, 16, "HAMMING"), ["r", "c"], ["re", "im"], 5)


@query(
    f"with {PX}, {dft_sql(SAMPLES)}, sf as (select r, (k+16)%32 k, re, im from ft), st(frame, s) as (values (0, 0), (1, 12), (2, 24)),"
    f" sl as (select frame*100000+r r, (k-s+12+16)%32 c, re, im from sf, st where k >= s and k < s+8), {dft_sql(SAMPLES, True, 'sl', 'bk')} select r//100000 frame, r%100000 r, k c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from bk"
)
def subaperture(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = spectral.subapertures(views.lines(spark, sf_dir), frames=3, fraction=0.25)
    each = frames.select("frame", "r", F.posexplode("z").alias("c", "v"))
    return each.select("frame", "r", F.col("c").cast("long").alias("c"), rounded(F.col("v.re")).alias("re"), rounded(F.col("v.im")).alias("im"))


@query(
    f"with {PX}, {dft_sql(SAMPLES)}, cl as (select band*100000+r r, k c, re*w re, im*w im from (select *, greatest(0, least(1, 1-abs((((k+16)%32)+0.5::double)/32-band/2.0::double)*2)) w from ft, range(3) b(band))),"
    f" {dft_sql(SAMPLES, True, 'cl', 'bk')} select r//100000 band, r%100000 r, k c, round(sqrt(re*re+im*im), 6) amplitude from bk"
)
def csi_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = spectral.colour_subapertures(views.lines(spark, sf_dir)).select("band", "r", F.posexplode("z").alias("c", "v"))
    amplitude = F.sqrt(F.col("v.re") * F.col("v.re") + F.col("v.im") * F.col("v.im"))
    return each.select("band", "r", F.col("c").cast("long").alias("c"), rounded(amplitude).alias("amplitude"))


@query(f"with {PX}, {dft_sql(SAMPLES)}, pw as (select k, 10*log10(avg(re*re+im*im)) db from ft group by 1) select k, round(db - (select min(db) from pw), 6) + 0.0 db from pw")
def mpsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spectral.mean_power_spectrum(views.pixels(spark, sf_dir), SAMPLES), ["k"], ["db"])


@query(f"with {PX} select c, round(sum(re*re+im*im), 6) power from px group by 1")
def range_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.pixels(spark, sf_dir)
    return px.groupBy("c").agg(rounded(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("power"))


@query(f"with {PX} select r%4 band, round(sum(0.5*(re*re+im*im))/1.44::double, 6) rcs from px where r between 20 and 220 and c between 4 and 20 group by 1")
def total_rcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chip = raster.area(views.pixels(spark, sf_dir), (20, 220), (4, 20)).withColumn("band", F.col("r") % 4)
    return chip.groupBy("band").agg(rounded(F.sum(0.5 * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))) / 1.44).alias("rcs"))


@query(f"with {PX}, {dft_sql(4 * SAMPLES)} select k, round(sum(re*re+im*im), 4) power from ft group by 1")
def slow_fast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ft = spectral.unpacked(spectral.padded(views.lines(spark, sf_dir), 4 * SAMPLES), along="k")
    return ft.groupBy("k").agg(rounded(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 4).alias("power"))


AMP = f"with {PX}, am as (select r, c, sqrt(re*re+im*im) a from px), me as (select avg(a) mean, avg(a*a) pw, min(a) lo, max(a) hi, count(*) n from am)"


def _density(low: float, multiple: float) -> str:
    slope = (255 - low) / math.log10(multiple)
    return f"({slope!r}::double*log10(greatest(a, 1e-5)) + ({low!r}::double - {slope!r}::double*log10(0.8::double*mean)))"


def _byte(value: str) -> str:
    return f"greatest(0, least(255, round({value})))::int"


def _remap(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return display.remapped(views.pixels(spark, sf_dir), kind)

    run.__name__ = f"remap_{kind}"
    query(AMP + f" select r, c, {_byte(_density(*display.DENSITY[kind]))} \"value\" from am, me")(run)


for _kind in display.DENSITY:
    _remap(_kind)


@query(AMP + f", d as (select r, c, {_density(30.0, 40.0)} v from am, me) select r, c, {_byte('case when v > 128 then (v+128)/2 else v end')} \"value\" from d")
def remap_pedf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.remapped(views.pixels(spark, sf_dir), "pedf")


@query(
    AMP + ", u as (select *, 10/mean un, greatest(1-lo*10/mean, 0) li, 10*log10(pw*(10/mean)*(10/mean)) ce from me), b as (select *, greatest(20*log10(lo*un+li), ce-25) dlo, least(20*log10(hi*un+li), ce+25) dhi from u)"
    f" select r, c, {_byte('255*(20*log10(a*un+li)-dlo)/(dhi-dlo)')} \"value\" from am, b"
)
def remap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.remapped(views.pixels(spark, sf_dir), "log")


@query(f"with {PX} select r, c, round(sqrt(re*re+im*im), 6) \"value\" from px")
def remap_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(display.remapped(views.pixels(spark, sf_dir), "linear"), ["r", "c"], ["value"])


@query(
    AMP + ", rk as (select a, row_number() over (order by a) - 1 k from am), ps as (select (n*0.99::double-0.5)/(n-1)*(n-1) p from me),"
    " pc as (select max(case when k = floor(p) then a end) + (max(case when k = ceil(p) then a end) - max(case when k = floor(p) then a end))*max(p-floor(p)) q from rk, ps),"
    f" v as (select r, c, case when a <= q then (a-lo)*220/(q-lo) else 35/log10((hi-lo)/(q-lo))*log10((a-lo)/(q-lo))+220 end v from am, me, pc) select r, c, {_byte('v')} \"value\" from v"
)
def remap_linlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.remapped(views.pixels(spark, sf_dir), "linlog")


@query(AMP + ", t as (select avg(a) + 3*stddev_samp(a) top from am) select r, c, round(least(a, top)/top, 6) \"value\" from am, t")
def clip_three_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(display.clipped(views.pixels(spark, sf_dir)), ["r", "c"], ["value"])


@query(f"with {PX}, m as (select max(greatest(abs(re), abs(im))) m from px) select r, c, round(re*32767/m)::int i, round(im*32767/m)::int q from px, m")
def int16_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.rescaled_int16(views.pixels(spark, sf_dir))


@query(AMP + " select least(floor((a-lo)/(hi-lo)*50)::bigint, 49) bin, count(*) n from am, me group by 1")
def contrast_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.histogram(views.pixels(spark, sf_dir)).select(F.col("bin").cast("long").alias("bin"), "n")


def _mag(re: str, im: str) -> str:
    return f"round(sqrt(({re})*({re})+({im})*({im})), 6)"


@query(f"with {BANDS} select r, c, {_mag('hh_re-vv_re', 'hh_im-vv_im')} red, {_mag('hv_re+vh_re', 'hv_im+vh_im')} green, {_mag('hh_re+vv_re', 'hh_im+vv_im')} blue from bd")
def pauli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(polarimetry.pauli(views.bands(spark, sf_dir)), ["r", "c"], ["red", "green", "blue"])


_COEFFICIENTS = polarimetry.coefficients(30.0, 10.0, 60.0, -5.0)
_RE = "+".join(f"({k.real!r})*{n}_re-({k.imag!r})*{n}_im" for n, k in zip(polarimetry.NAMES, _COEFFICIENTS, strict=True))
_IM = "+".join(f"({k.real!r})*{n}_im+({k.imag!r})*{n}_re" for n, k in zip(polarimetry.NAMES, _COEFFICIENTS, strict=True))


@query(f"with {BANDS} select r, c, round({_RE}, 6) + 0.0 re, round({_IM}, 6) + 0.0 im from bd")
def pol_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(polarimetry.synthesised(views.bands(spark, sf_dir), 30.0, 10.0, 60.0, -5.0), ["r", "c"], ["re", "im"])


_STOKES = "hh_re*hh_re+hh_im*hh_im+(hv_re*hv_re+hv_im*hv_im) s0, hh_re*hh_re+hh_im*hh_im-(hv_re*hv_re+hv_im*hv_im) s1, 2*(hh_re*hv_re+hh_im*hv_im) s2, -2*(hh_im*hv_re-hh_re*hv_im) s3, 1.0::double n"


def _smooth(columns: list[str]) -> str:
    means = ", ".join(f"avg({x}) m{x}" for x in columns)
    values = ", ".join(f"({x}+(9-n)*m{x})/9 {x}" for x in columns)
    return box("st", [*columns, "n"], 1) + f", me as (select {means} from st), sm as (select r, c, {values} from box, me)"


@query(
    f"with {BANDS}, st as (select r, c, {_STOKES} from bd), {_smooth(['s0', 's1', 's2', 's3'])}, po as (select *, sqrt(s1*s1+s2*s2+s3*s3) p from sm)"
    " select r, c, round(s0, 6) + 0.0 s0, round(s1, 6) + 0.0 s1, round(s2, 6) + 0.0 s2, round(s3, 6) + 0.0 s3, round(p/s0, 6) + 0.0 degree, round(degrees(atan2(s2, s1)/2), 4) + 0.0 psi,"
    " round(degrees(asin(greatest(-1, least(1, s3/p)))/2), 4) + 0.0 chi, round(degrees(atan2(s3, s2)), 4) + 0.0 delta from po"
)
def stokes_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = polarimetry.stokes(views.bands(spark, sf_dir))
    return out.select("r", "c", *[rounded(F.col(x), 6).alias(x) for x in ("s0", "s1", "s2", "s3", "degree")], *[rounded(F.col(x), 4).alias(x) for x in ("psi", "chi", "delta")])


_P = "(hh_re+vv_re)*(hh_re+vv_re)+(hh_im+vv_im)*(hh_im+vv_im) p1, (hh_re-vv_re)*(hh_re-vv_re)+(hh_im-vv_im)*(hh_im-vv_im) p2, (hv_re-vh_re)*(hv_re-vh_re)+(hv_im-vh_im)*(hv_im-vh_im) p3, 1.0::double n"


@query(
    f"with {BANDS}, st as (select r, c, {_P} from bd), {_smooth(['p1', 'p2', 'p3'])}, q as (select r, c, p1/(p1+p2+p3) q1, p2/(p1+p2+p3) q2, p3/(p1+p2+p3) q3 from sm)"
    " select r, c, round(degrees(acos(sqrt(least(1, q1)))), 4) + 0.0 alpha, round(1.5::double*(1-(q1*q1+q2*q2+q3*q3)), 6) + 0.0 entropy from q"
)
def alpha_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = polarimetry.alpha_entropy(views.bands(spark, sf_dir))
    return out.select("r", "c", rounded(F.col("alpha"), 4).alias("alpha"), rounded(F.col("entropy")).alias("entropy"))


@query(
    f"with {BANDS} "
    + " union all ".join(f"select '{a}' a, '{b}' b, round(sum({a}_re*{b}_re+{a}_im*{b}_im), 5) + 0.0 re, round(sum({a}_re*{b}_im-{a}_im*{b}_re), 5) + 0.0 im from bd" for a in polarimetry.NAMES for b in polarimetry.NAMES)
)
def band_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(polarimetry.covariance(views.bands(spark, sf_dir)), ["a", "b"], ["re", "im"], 5)
