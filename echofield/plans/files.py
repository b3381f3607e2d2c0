"""Round trips through files: what was written is read again by the opener."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import rounded
from ..sources import cosar, cphd, opened, sicd, sio, tiff
from ..sources.patches import scratch_file
from . import views
from .views import PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, path: str, scale: float = 1.0, digits: int = 6, **options: object) -> DataFrame:
    px = opened.open_reader(spark, path, **options)
    return px.select("r", "c", rounded(F.col("re") / scale, digits).alias("re"), rounded(F.col("im") / scale, digits).alias("im"))


ALL = f"with {PX} select r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px"
#: Numbers of 16 bits after multiplication by 1000.
SHORT = f"with {PX} select r, c, round(round_even(re*1000, 0)/1000, 6) + 0.0 re, round(round_even(im*1000, 0)/1000, 6) + 0.0 im from px"


def _written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[DataFrame, str, int], None]) -> str:
    path = scratch_file(spark, name)
    write(views.pixels(spark, sf_dir), path, views.height(spark, sf_dir))
    return path


@query(ALL)
def sio_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, _written(spark, sf_dir, "image.sio", lambda px, path, n: sio.write_sio(px, path, n, SAMPLES)))


@query(f"{ALL} where r >= 100 and r < 300 and c = 7 and r % 4 = 0")
def sio_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and strides are pushed down to the bytes that are read."""
    path = _written(spark, sf_dir, "image.sio", lambda px, path, n: sio.write_sio(px, path, n, SAMPLES))
    return _read(spark, path, rowstride=4).where("r >= 100 and r < 300 and c = 7")


@query(ALL)
def sicd_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, _written(spark, sf_dir, "image.nitf", lambda px, path, n: sicd.write_sicd(px, path, n, SAMPLES, segment_rows=200)))


@query(ALL)
def flat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of a file whose geometry the reader is told."""
    path = _written(spark, sf_dir, "image.bin", lambda px, path, n: sio.write_sio(px, path, n, SAMPLES))
    opened.registered(spark)
    px = spark.read.format("flatraster").options(rows=views.height(spark, sf_dir), cols=SAMPLES, offset=20, bigendian="true").load(path)
    return px.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pixels(spark, sf_dir).select("r", "c", (F.col("re") * 1000).alias("re"), (F.col("im") * 1000).alias("im"))


@query(ALL)
def tiff_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, _written(spark, sf_dir, "image.tif", lambda px, path, n: tiff.write_pixels(px, path, n, SAMPLES)))


@query(SHORT)
def tiff_short_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_file(spark, "image.tif")
    tiff.write_pixels(_scaled(spark, sf_dir), path, views.height(spark, sf_dir), SAMPLES, ">i2", 7)
    return _read(spark, path, 1000.0)


def _turned(px: DataFrame) -> DataFrame:
    return px.select(F.col("c").alias("r"), F.col("r").alias("c"), "re", "im")


@query(SHORT.replace("select r, c,", "select r c, c r,"))
def cosar_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are azimuth, so they are the columns of what is read."""
    path = scratch_file(spark, "image.cos")
    cosar.write_pixels(_turned(_scaled(spark, sf_dir)), path, SAMPLES, views.height(spark, sf_dir))
    return _read(spark, path, 1000.0)


@query("with n as (select max(vec_id) + 1 n from embeddings) select range r, 0::bigint first, (case when range = 0 then (n - 1) // 3 * 3 else n - 1 end)::bigint last from n, range(32)")
def cosar_valid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first range sample is valid in every third line only."""
    path = scratch_file(spark, "image.cos")
    cosar.write_pixels(_turned(views.pixels(spark, sf_dir)), path, SAMPLES, views.height(spark, sf_dir), (F.col("c") % 3 != 0).cast("long"))
    return cosar.valid_places(spark, path)


@query(f"with {PX} select r vec, c k, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im, round(r*0.001::double, 6) tx_time from px")
def cphd_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulses = views.pulses(spark, sf_dir).join(views.lines(spark, sf_dir).withColumnRenamed("r", "vec"), "vec")
    path = scratch_file(spark, "pulses.cphd")
    cphd.write_cphd(pulses, path)
    back = opened.open_reader(spark, path)
    each = back.select("vec", "tx_time", F.posexplode("z").alias("k", "z"))
    return each.select("vec", F.col("k").cast("long").alias("k"), rounded(F.col("z.re")).alias("re"), rounded(F.col("z.im")).alias("im"), F.round("tx_time", 6).alias("tx_time"))
