"""Change detection between two registered images (ar, ai) and (br, bi)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import window_sums

SUMS = ["xr", "xi", "pa", "pb"]


def _products(pair: DataFrame) -> DataFrame:
    a2, b2 = F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai"), F.col("br") * F.col("br") + F.col("bi") * F.col("bi")
    return pair.select(
        "r",
        "c",
        (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")).alias("xr"),
        (F.col("ar") * F.col("bi") - F.col("ai") * F.col("br")).alias("xi"),
        a2.alias("pa"),
        b2.alias("pb"),
    )


def _cross():
    return F.sqrt(F.col("xr") * F.col("xr") + F.col("xi") * F.col("xi"))


def coherence(pair: DataFrame, half: int = 2) -> DataFrame:
    """r, c, coherence, phase; no energy gives 0."""
    sums = window_sums(_products(pair), SUMS, half, half)
    energy = F.col("pa") * F.col("pb")
    return sums.select("r", "c", F.when(energy > 0, _cross() / F.sqrt(energy)).otherwise(0.0).alias("coherence"), F.atan2("xi", "xr").alias("phase"))


def noise_aware_coherence(pair: DataFrame, noise_a: float, noise_b: float, half: int = 2) -> DataFrame:
    """2 |sum| over the energy less the expected noise; outside 0 to 1 gives 1."""
    sums = window_sums(_products(pair), SUMS, half, half)
    n = (2 * half + 1) ** 2
    value = 2 * _cross() / (F.col("pa") + F.col("pb") - n * (noise_a + noise_b))
    return sums.select("r", "c", F.when(value.between(0.0, 1.0), value).otherwise(1.0).alias("coherence"))


def signal_correlation(pair: DataFrame, noise_a: float, noise_b: float, half: int = 2) -> DataFrame:
    """Real correlation over the signal above the noise; windows without signal give -100."""
    sums = window_sums(_products(pair), SUMS, half, half)
    n = (2 * half + 1) ** 2
    a, b = F.col("pa") / (2 * n) - noise_a, F.col("pb") / (2 * n) - noise_b
    value = 2 * F.col("xr") / (4 * n * F.sqrt(F.abs(a * b)))
    return sums.select("r", "c", F.when((a > 0) & (b > 0), value).otherwise(-100.0).alias("correlation"))


def amplitude_change(pair: DataFrame) -> DataFrame:
    """Red where the reference is brighter, cyan where the match is."""
    a = F.sqrt(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai"))
    b = F.sqrt(F.col("br") * F.col("br") + F.col("bi") * F.col("bi"))
    return pair.select("r", "c", a.alias("red"), b.alias("green"), b.alias("blue"))


def turned_coherence(pair: DataFrame, rows: int, cols: int, quarter_turns: int) -> DataFrame:
    """Coherence over a window that is turned by quarter turns: an odd number swaps its sides."""
    from .raster import sized_window_sums

    if quarter_turns % 2:
        rows, cols = cols, rows
    ar, ai, br, bi = (F.col(x) for x in ("ar", "ai", "br", "bi"))
    products = pair.select("r", "c", (ar * br + ai * bi).alias("xr"), (ar * bi - ai * br).alias("xi"), (ar * ar + ai * ai).alias("pa"), (br * br + bi * bi).alias("pb"))
    sums = sized_window_sums(products, ["xr", "xi", "pa", "pb"], rows, cols)
    both = F.col("pa") * F.col("pb")
    value = F.sqrt(F.col("xr") * F.col("xr") + F.col("xi") * F.col("xi")) / F.sqrt(both)
    return sums.select("r", "c", F.when(both > 0, value).otherwise(0.0).alias("coherence"))
