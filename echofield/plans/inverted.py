"""Queries that go from images back to apertures, and over streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import rounded
from ..operators import apertures
from ..operators.spectral import unpacked
from ..sources.patches import scratch_file
from ..streaming import spectra
from . import views
from .pixels import dft_columns, dft_sql
from .views import HEIGHT, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


CENTRE, SPACING, BANDWIDTH = 100.0, (0.05, 0.05), (16.0, 15.0)

#: The centred spectrum f2 (r: azimuth, c: range), and the geometry g of the annulus.
_SPECTRUM = (
    f"{PX}, {HEIGHT}, {dft_sql(SAMPLES, name='f1')}, tr as (select k r, r c, re, im from f1), {dft_columns('tr', 'f0')},"
    " f2 as (select (k+height//2)%height u, (r+16)%32 v, re/sqrt(height*32.0::double) re, im/sqrt(height*32.0::double) im from f0, he),"
    " g as (select height n, -10.0::double u0, 20.0::double/(height-1) du, 90.0::double v0, 20.0::double/31 dv, asin(8/107.5::double) a, 92.5::double/cos(asin(8/107.5::double)) r0, 107.5::double r1 from he)"
)


def _geometry(spark: SparkSession, sf_dir: str) -> apertures.Wavenumbers:
    return apertures.Wavenumbers(views.height(spark, sf_dir), SAMPLES, CENTRE, SPACING, BANDWIDTH)


def _lerp(name: str) -> str:
    return f"a.{name}*(1-w)+b.{name}*w"


@query(
    f"with {_SPECTRUM}, q as (select range k, v, -a+2*a*range/(n-1) ang, (tan(-a+2*a*range/(n-1))*(v0+v*dv)-u0)/du at_u from g, range(0, (select n from g)), range(32) t(v)),"
    f" ks as (select k, q.v, ang, {_lerp('re')} re, {_lerp('im')} im from (select *, floor(at_u)::bigint lo, at_u-floor(at_u) w from q) q join f2 a on a.u=lo and a.v=q.v join f2 b on b.u=lo+1 and b.v=q.v),"
    " p as (select distinct k, ang, j, ((r0+(r1-r0)*j/31)*cos(ang)-v0)/dv at_v from ks, g, range(32) t(j))"
    f" select k r, j c, round({_lerp('re')}, 6) + 0.0 re, round({_lerp('im')}, 6) + 0.0 im from (select *, floor(at_v)::bigint lo, at_v-floor(at_v) w from p) p join ks a using (k) join ks b using (k) where a.v=lo and b.v=lo+1"
)
def inverse_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image's spectrum on rays and radii."""
    out = unpacked(apertures.inverse_polar(views.lines(spark, sf_dir), _geometry(spark, sf_dir)))
    return out.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


#: Rays and radii of the box that is kept: a quarter to three quarters of each.
_CORNERS = (
    "bx as (select -a+2*a*(n//4)/(n-1) a0, -a+2*a*(3*n//4)/(n-1) a1, r0+(r1-r0)*8/31 q0, r0+(r1-r0)*24/31 q1, u0, du, v0, dv from g),"
    " co as (select i, case i//10 when 0 then a0 when 1 then a0+(a1-a0)*(i%10)/9 when 2 then a1 else a1+(a0-a1)*(i%10)/9 end ang,"
    " case i//10 when 0 then q0+(q1-q0)*(i%10)/9 when 1 then q1 when 2 then q1+(q0-q1)*(i%10)/9 else q0 end rad, u0, du, v0, dv from bx, range(40) t(i)),"
    " vx as (select i, (rad*sin(ang)-u0)/du y, (rad*cos(ang)-v0)/dv x from co), ed as (select p.y y1, p.x x1, q.y y2, q.x x2 from vx p join vx q on q.i = (p.i+1)%40 where p.y <> q.y)"
)


@query(
    f"with {_SPECTRUM}, {_CORNERS}, hit as (select u, v, count(*) filter ((y1 > u) <> (y2 > u) and v < (u-y1)*(x2-x1)/(y2-y1)+x1) % 2 = 1 kept from f2, ed group by 1, 2)"
    " select u r, v c, case when kept then round(re, 6) + 0.0 else 0 end re, case when kept then round(im, 6) + 0.0 else 0 end im from f2 join hit using (u, v)"
)
def polar_aperture_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum within a box of rays and radii."""
    k = _geometry(spark, sf_dir)
    corners = apertures.box_corners(k, (k.n_u // 4, 3 * k.n_u // 4), (8, 24))
    out = apertures.masked(apertures.spectrum(views.lines(spark, sf_dir), k), corners)
    return out.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


# Streams

SIZE, STEP, LATE_MS = 4, 2, 60_000
_KAISER = "[" + ", ".join(f"{float(x)!r}::double" for x in spectra.kaiser(SIZE, 5.0)) + "]"


@query(
    "with s as (select user_id platform, epoch_us(ts) us, \"value\"::double re from events), n as (select *, row_number() over (partition by platform order by us, re) - 1 k from s),"
    " mark as (select (max(us)//1000 - 60000)*1000 mark from s), f as (select platform, frame, k - 2*frame j, us, re from n, range(0, (select max(k) from n)//2 + 1) t(frame) where k between 2*frame and 2*frame + 3),"
    " w as (select platform, frame, min(us) as start, max(us) last, count(*) m from f group by 1, 2),"
    f" p as (select platform, frame, bin, pow(sum(re*{_KAISER}[j+1]*cos(-2*pi()*j*(bin-2)/4)), 2) + pow(sum(re*{_KAISER}[j+1]*sin(-2*pi()*j*(bin-2)/4)), 2) power from f, range(4) b(bin) group by 1, 2, 3)"
    " select platform, frame, start, bin::int bin, round(power, 3) + 0.0 power from p join w using (platform, frame), mark where m = 4 and last < mark"
)
def stream_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every user's events, streamed with a minute of lateness; kept until a watermark has passed them."""
    out, checkpoint = (f"file://{scratch_file(spark, x)}" for x in ("frames", "frames-checkpoint"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spectra.prepared(spark)
    try:
        stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
        samples = stream.select(F.col("user_id").alias("platform"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
        made = spectra.streamed(samples, SIZE, STEP, f"{LATE_MS} milliseconds")
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    back = spark.read.schema(spectra.SCHEMA).parquet(out)
    return back.select("platform", "frame", "start", "bin", rounded(F.col("power"), 3).alias("power"))
