"""Orbit files in place of a product's own state vectors.

A product takes the best orbit file whose validity holds its times. Both sides meet on the
days that they touch, so that files and products are joined on equal keys; a product's
state vectors are found in the same way, in slots of time. All products go through one
plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouped

DAY = 86_400.0
#: Seconds of a slot of state vectors.
SLOT = 3_600.0


def assigned(products: DataFrame, files: DataFrame, margin: float = 1.0) -> DataFrame:
    """product, file: the valid orbit file of highest rank, then of latest creation; products without one are left out.

    products: product, mission, start, stop in seconds. files: file, mission, rank,
    created, valid_from, valid_to. A file holds a product if it is valid from margin
    seconds before the start to margin seconds after the stop.
    """
    day = lambda c: F.floor(F.col(c) / DAY)
    # A file that holds a product touches the day of its start.
    spread = files.withColumn("day", F.explode(F.sequence(day("valid_from"), day("valid_to"))))
    both = products.withColumn("day", day("start")).join(spread, ["mission", "day"])
    held = both.where((F.col("valid_from") <= F.col("start") - margin) & (F.col("valid_to") >= F.col("stop") + margin))
    return held.groupBy("product").agg(F.max_by("file", F.struct("rank", "created", "file")).alias("file"))


def overridden(products: DataFrame, own: DataFrame, files: DataFrame, states: DataFrame, margin: float = 1.0, reach: float = 1.0) -> DataFrame:
    """product, source, t, x, y, z: state vectors of the orbit file, else the product's own.

    own: product, t, x, y, z. states: file, t, x, y, z. Of a file those within reach
    seconds of the product's times are taken.
    """
    chosen = assigned(products, files, margin)
    slot = lambda c: F.floor(c / SLOT)
    wanted = products.join(chosen, "product").withColumn("slot", F.explode(F.sequence(slot(F.col("start") - reach), slot(F.col("stop") + reach))))
    found = wanted.join(states.withColumn("slot", slot(F.col("t"))), ["file", "slot"]).where(F.col("t").between(F.col("start") - reach, F.col("stop") + reach))
    better = found.select("product", F.col("file").alias("source"), "t", "x", "y", "z")
    rest = own.join(better.select("product").distinct(), "product", "left_anti")
    return better.unionByName(rest.select("product", F.lit("product").alias("source"), "t", "x", "y", "z"))


def position_fits(states: DataFrame, products: DataFrame, order: int = 5) -> DataFrame:
    """product and its polynomials x_poly, y_poly, z_poly of seconds since the product's start."""
    since = states.join(products.select("product", "start"), "product").withColumn("s", F.col("t") - F.col("start"))
    return grouped.polynomials(since, ["product"], "s", ["x", "y", "z"], order)
