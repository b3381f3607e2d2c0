"""Deterministic radar-shaped views over the test tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Complex samples of a vector of 64 numbers.
SAMPLES = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, re, im: a vector is a line, pairs of its numbers are samples."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), "embedding")
    each = rows.select("r", "embedding", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("c"))
    return each.select(
        "r",
        F.col("c").cast("long").alias("c"),
        F.get("embedding", 2 * F.col("c")).cast("double").alias("re"),
        F.get("embedding", 2 * F.col("c") + 1).cast("double").alias("im"),
    )


PX = "px as (select vec_id r, i c, embedding[2*i+1]::double re, embedding[2*i+2]::double im from embeddings, range(32) t(i))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, z: packed lines, for whole-line kernels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("r"), "embedding")
    pair = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda c: F.struct(F.get("embedding", 2 * c).cast("double").alias("re"), F.get("embedding", 2 * c + 1).cast("double").alias("im")))
    return rows.select("r", pair.alias("z"))


def height(spark: SparkSession, sf_dir: str) -> int:
    """Lines of the image."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


HEIGHT = "he as (select max(vec_id) + 1 height from embeddings)"


def image_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c, ar, ai, br, bi: even lines and odd lines as two images registered by (r, c)."""
    px = pixels(spark, sf_dir).withColumn("odd", F.col("r") % 2 == 1).withColumn("r", F.expr("r div 2"))
    a = px.where(~F.col("odd")).select("r", "c", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = px.where("odd").select("r", "c", F.col("re").alias("br"), F.col("im").alias("bi"))
    return a.join(b, ["r", "c"])


PAIR = f"{PX}, pr as (select a.r // 2 r, a.c, a.re ar, a.im ai, b.re br, b.im bi from px a join px b on b.r = a.r + 1 and b.c = a.c where a.r % 2 = 0)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, c and the four polarimetric bands' complex samples."""
    px = pixels(spark, sf_dir).select(F.expr("r div 4").alias("r"), "c", (F.col("r") % 4).alias("band"), "re", "im")
    names = ["hh", "hv", "vh", "vv"]
    pivot = [F.max(F.when(F.col("band") == k, F.col(p))).alias(f"{n}_{p}") for k, n in enumerate(names) for p in ("re", "im")]
    return px.groupBy("r", "c").agg(*pivot)


BANDS = (
    PX
    + ", bd as (select r // 4 r, c, "
    + ", ".join(f"max(case when r % 4 = {k} then {p} end) {n}_{p}" for k, n in enumerate(["hh", "hv", "vh", "vv"]) for p in ("re", "im"))
    + " from px group by 1, 2)"
)


def collects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of collections, made from orders and their customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("collect_id"),
        F.col("c_nationkey").alias("collector"),
        F.col("o_orderdate").alias("collect_start"),
        (((F.col("o_custkey") * 37) % 1200).cast("double") / 10 - 60).alias("lat"),
        (((F.col("o_custkey") * 91) % 3600).cast("double") / 10 - 180).alias("lon"),
        (key % 500).cast("double").alias("hae"),
        (20 + key % 50).cast("double").alias("graze"),
        ((key * 7) % 360).cast("double").alias("azim"),
        F.when(key % 2 == 0, "L").otherwise("R").alias("side"),
        F.element_at(F.array(*map(F.lit, ["H:H", "H:V", "V:H", "V:V"])), (key % 4 + 1).cast("int")).alias("pol"),
    )


COLLECT = (
    "co as (select o_orderkey collect_id, c_nationkey collector, o_orderdate collect_start, ((o_custkey*37)%1200)::double/10-60 lat,"
    " ((o_custkey*91)%3600)::double/10-180 lon, (o_orderkey%500)::double hae, (20+o_orderkey%50)::double graze, ((o_orderkey*7)%360)::double azim,"
    " case when o_orderkey%2=0 then 'L' else 'R' end side, case o_orderkey%4 when 0 then 'H:H' when 1 then 'H:V' when 2 then 'V:H' else 'V:V' end pol"
    " from orders join customer on o_custkey=c_custkey)"
)


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-vector parameters of a spotlight collection."""
    v = F.col("vec_id").cast("double")
    angle = (v - 250) * 0.00002
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vec"),
        (v * 0.001).alias("tx_time"),
        (7000000.0 * F.cos(angle)).alias("tx_x"),
        (7000000.0 * F.sin(angle)).alias("tx_y"),
        F.lit(500000.0).alias("tx_z"),
        F.lit(6378137.0).alias("srp_x"),
        F.lit(0.0).alias("srp_y"),
        F.lit(0.0).alias("srp_z"),
        F.lit(9.6e9).alias("sc0"),
        F.lit(1.0e6).alias("scss"),
    )


PULSE = (
    "pu as (select vec_id vec, vec_id::double*0.001 tx_time, 7000000.0*cos((vec_id::double-250)*0.00002) tx_x,"
    " 7000000.0*sin((vec_id::double-250)*0.00002) tx_y, 500000.0::double tx_z, 6378137.0::double srp_x, 0.0::double srp_y, 0.0::double srp_z,"
    " 9.6e9::double sc0, 1.0e6::double scss from embeddings)"
)
