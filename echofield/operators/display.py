"""Amplitudes to display values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Darkest value and contrast multiple of each density remap.
DENSITY = {"density": (30.0, 40.0), "brighter": (60.0, 40.0), "darker": (0.0, 40.0), "highcontrast": (30.0, 4.0)}


#: Display value where the linear part of the lin-log remap ends.
LINLOG_KNEE = 220


def plotting_percentile(values: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the percentile, linear between plotting positions (i - 0.5) / n."""
    n = values.agg(F.count(column)).first()[0]
    at = min(max((n * p - 0.5) / max(n - 1, 1), 0.0), 1.0)
    return values.agg(F.percentile(column, F.lit(at)).alias("percentile"))


def amplitudes(px: DataFrame) -> DataFrame:
    return px.select("r", "c", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("a"))


def byte(value: Column) -> Column:
    """Rounded half away from zero and saturated; NaN gives 0."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.nanvl(value, F.lit(0.0))))).cast("int")


def density(a: Column, mean: Column, darkest: float = 30.0, multiple: float = 40.0) -> Column:
    """Logarithmic from 0.8 of the mean (darkest) to ``multiple`` times that (255)."""
    low = 0.8 * mean
    slope = (255 - darkest) / math.log10(multiple)
    return slope * F.log10(F.greatest(a, F.lit(1e-5))) + (darkest - slope * F.log10(low))


def _with(px: DataFrame, *aggregates: Column) -> DataFrame:
    """Amplitudes with whole-image numbers, which are one row."""
    a = amplitudes(px)
    return a.join(F.broadcast(a.where(~F.isnan("a") & (F.abs("a") < float("inf"))).agg(*aggregates)))


def remapped(px: DataFrame, kind: str = "density") -> DataFrame:
    """r, c, value (0 to 255)."""
    if kind in DENSITY:
        value = density(F.col("a"), F.col("mean"), *DENSITY[kind])
        return _with(px, F.avg("a").alias("mean")).select("r", "c", byte(value).alias("value"))
    if kind == "pedf":
        value = density(F.col("a"), F.col("mean"))
        halved = F.when(value > 128, (value + 128) / 2).otherwise(value)
        return _with(px, F.avg("a").alias("mean")).select("r", "c", byte(halved).alias("value"))
    if kind == "log":
        # 50 dB around the rms; small images are lifted to at least one first.
        scaled = _with(px, F.avg("a").alias("mean"), F.min("a").alias("least"), F.max("a").alias("most"), F.avg(F.col("a") * F.col("a")).alias("power"))
        unit = 10 / F.col("mean")
        lift = F.greatest(1 - F.col("least") * unit, F.lit(0.0))
        centre = 10 * F.log10(F.col("power") * unit * unit)
        low = F.greatest(20 * F.log10(F.col("least") * unit + lift), centre - 25)
        high = F.least(20 * F.log10(F.col("most") * unit + lift), centre + 25)
        value = 20 * F.log10(F.col("a") * unit + lift)
        return scaled.select("r", "c", byte(255 * (value - low) / (high - low)).alias("value"))
    if kind == "linear":
        return amplitudes(px).select("r", "c", F.col("a").alias("value"))
    if kind == "linlog":
        scaled = _with(px, F.min("a").alias("least"), F.max("a").alias("most")).join(F.broadcast(plotting_percentile(amplitudes(px), "a", 0.99)))
        a, low, high = F.col("a"), F.col("least"), F.col("percentile")
        slope = (255 - LINLOG_KNEE) / F.log10((F.col("most") - low) / (high - low))
        value = F.when(a <= high, (a - low) * LINLOG_KNEE / (high - low)).otherwise(slope * F.log10((a - low) / (high - low)) + LINLOG_KNEE)
        return scaled.select("r", "c", byte(value).alias("value"))
    raise ValueError(f"unknown remap {kind}")


def clipped(px: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Amplitudes clipped at mean + deviations * sd, from 0 to 1."""
    top = (F.avg("a") + deviations * F.stddev_samp("a")).alias("top")
    return _with(px, top).select("r", "c", (F.least("a", "top") / F.col("top")).alias("value"))


def rescaled_int16(px: DataFrame) -> DataFrame:
    """I and Q scaled so that the largest finite part is 32767."""
    largest = px.agg(F.max(F.greatest(F.abs("re"), F.abs("im"))).alias("largest"))
    return px.join(F.broadcast(largest)).select("r", "c", F.round(F.col("re") * 32767 / F.col("largest")).cast("int").alias("i"), F.round(F.col("im") * 32767 / F.col("largest")).cast("int").alias("q"))


def histogram(px: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n) of amplitudes between the least and the largest."""
    spread = _with(px, F.min("a").alias("least"), F.max("a").alias("most"))
    place = F.least(F.floor((F.col("a") - F.col("least")) / (F.col("most") - F.col("least")) * bins), F.lit(bins - 1))
    return spread.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
