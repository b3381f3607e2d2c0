"""Queries over views of images, lists and small files, with their SQL."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import rounded
from ..operators import raster, viewer
from ..sources import opened, sio
from ..sources.patches import scratch_file
from . import views
from .views import COLLECT, HEIGHT, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_VIEW = (
    f"with {PX}, {HEIGHT}, e as (select greatest(1, floor(height/2.0::double-3*(40-1)/2.0::double+0.5))::bigint top from he), v as (select (r-top+1)//3 r, (c-2)//3 c, sqrt(re*re+im*im) a from px, e"
    " where r between top-1 and top-1+119 and c between 2 and 31 and (r-top+1)%3 = 0 and (c-2)%3 = 0), m as (select avg(a) mean from v)"
)


@query(_VIEW + " select r, c, greatest(0, least(255, round((225/log10(40.0::double))*log10(greatest(a, 1e-5)) + 30 - (225/log10(40.0::double))*log10(0.8::double*mean))))::int \"value\" from v, m")
def viewer_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of the image at a third of its scale."""
    height = views.height(spark, sf_dir)
    return viewer.shown(views.pixels(spark, sf_dir), height, SAMPLES, (height / 2, 17.0), (40, 10), 3)


@query(_VIEW + " select r, c, greatest(0, least(255, round(100*sqrt(a/mean))))::int \"value\" from v, m")
def user_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own remap."""
    height = views.height(spark, sf_dir)
    return viewer.shown(views.pixels(spark, sf_dir), height, SAMPLES, (height / 2, 17.0), (40, 10), 3, lambda a, mean: 100 * F.sqrt(a / mean))


@query(
    f"with {COLLECT}, k as (select collect_id, (collect_id%500)::double place, (collect_id%37+1)::double origin, case collect_id%3 when 0 then 0.5::double when 1 then 1 else 4 end scale from co)"
    " select collect_id, round(case when scale < 1 then place+origin-1 else scale*(place-1)+origin end, 6) native, round(case when scale < 1 then place-origin+1 else (place-origin)/scale+1 end, 6) + 0.0 axes from k"
)
def view_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("collect_id")
    place, origin = (k % 500).cast("double"), (k % 37 + 1).cast("double")
    scale = F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 1.0).otherwise(4.0)
    return views.collects(spark, sf_dir).select("collect_id", F.round(viewer.to_native(place, origin, scale), 6).alias("native"), rounded(viewer.to_axes(place, origin, scale)).alias("axes"))


@query(f"with {COLLECT} select collect_id::varchar name, side call, pol kind, '1' selected, '0' polarimetric from co")
def algorithm_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string(" %d , %s,%s , 1, 0", "collect_id", "side", "pol")
    return viewer.registry(views.collects(spark, sf_dir).select(line.alias("line")))


@query(f"with {PX} select r-40 r, c-3 c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px where r between 40 and 239 and c between 3 and 26")
def chip_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of an image as a file of its own."""
    path = scratch_file(spark, "chip.sio")
    sio.write_sio(raster.subset(views.pixels(spark, sf_dir), (40, 239), (3, 26)), path, 200, 24)
    px = opened.open_reader(spark, path)
    return px.select("r", "c", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


@query(f"with {COLLECT} select collect_id, pol, round(graze, 3) graze from co")
def catalog_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as comma-separated files, a file for each task, read again."""
    path = os.path.join(tempfile.mkdtemp(prefix="echofield-files-"), "catalog")
    views.collects(spark, sf_dir).select("collect_id", "pol", "graze").write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema("collect_id long, pol string, graze double").csv(path)
    return back.select("collect_id", "pol", F.round("graze", 3).alias("graze"))
