"""Axes and filters for cross sections, user functions, and registration of images."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import LIGHT
from .spectral import on_lines, packed, transformed_2d, unpacked

#: Functions that users give names to.
REGISTRY: dict[str, Callable] = {}


def registered(name: str) -> Callable[[Callable], Callable]:
    """Makes a function of amplitudes known by a name."""

    def keep(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return keep


def by_lines(lines: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A user's function of complex lines, one array of lines at a time."""
    return on_lines(lines, kernel)


def by_blocks(px: DataFrame, block: int, overlap: int, kernel: Callable[[np.ndarray], np.ndarray], n_rows: int) -> DataFrame:
    """A user's function of blocks of lines with a halo on both sides.

    Lines in a halo are sent to two blocks; the halo's own results are left out.
    """
    reach = F.sequence(F.floor((F.col("r") - overlap) / block), F.floor((F.col("r") + overlap) / block))
    sent = px.withColumn("_block", F.explode(reach)).where((F.col("_block") >= 0) & (F.col("_block") <= (n_rows - 1) // block))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["_block"].iloc[0]) * block
        grid = rows.assign(z=rows.re + 1j * rows.im).pivot(index="r", columns="c", values="z").sort_index()
        out = kernel(grid.to_numpy())
        keep = (grid.index >= first) & (grid.index < first + block)
        r, c = np.meshgrid(grid.index[keep], grid.columns, indexing="ij")
        return pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "re": out[keep].real.ravel(), "im": out[keep].imag.ravel()})

    return sent.groupBy("_block").applyInPandas(run, "r long, c long, re double, im double")


def fast_time_axis(bins: DataFrame, centre: float, spacing: float, n: int) -> DataFrame:
    """Adds gigahertz of fast-time bins k; centre in cycles per metre, spacing in metres."""
    low, width = centre * LIGHT / 2 - LIGHT / (4 * spacing), LIGHT / (2 * spacing)
    return bins.withColumn("gigahertz", (low + width * F.col("k") / max(n - 1, 1)) / 1e9)


def slow_time_axis(bins: DataFrame, n: int, duration: float, angle: float, azimuth: float, fill: float = 1.0, left: bool = False) -> DataFrame:
    """Adds seconds, polar angle and azimuth of slow-time bins k; padding widens them."""
    place = F.col("k") / max(n - 1, 1) - 0.5
    place = -place if left else place
    return bins.withColumns({"seconds": (place * fill + 0.5) * duration, "polar_angle": place * (fill * angle), "azimuth": F.pmod(place * (fill * angle) + azimuth + 360, F.lit(360.0))})


def collect_duration(angle: Column, slant_range: Column, speed: Column, cone: Column) -> Column:
    """Effective seconds of an aperture: angle * range / (speed * sin of the cone angle)."""
    return angle * slant_range / (speed * F.sin(F.radians(cone)))


def azimuth_over_aperture(collects: DataFrame, duration: float | Column, speed: float | Column, height: float | Column) -> DataFrame:
    """Adds (percent, azimuth) at each percent of the aperture that a collect's platform flies straight."""
    whole, fast, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (duration, speed, height))
    at = F.col("percent") / 100 * whole - whole / 2
    spread = collects.select("*", F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(10))).alias("percent"))
    return spread.withColumn("azimuth", F.pmod(F.degrees(F.atan2(at * fast, high)) + 360, F.lit(360.0)))


def aperture_weights(kind: str, n: int) -> np.ndarray:
    place = np.linspace(-1, 1, n)
    kinds = {
        "GAUSSIAN": lambda: np.exp(-0.5 * (2.5 * place) ** 2),
        "X4": lambda: 1 / (1 + (2 * place) ** 4),
        "HAMMING": lambda: 0.54 + 0.46 * np.cos(np.pi * place),
        "COSINE": lambda: 0.5 + 0.5 * np.cos(np.pi * place / 2),
        "NONE": lambda: np.ones(n),
    }
    if kind.upper() not in kinds:
        raise ValueError(f"unknown filter {kind}")
    return kinds[kind.upper()]()


def _weight(kind: str, k: Column, n: int) -> Column:
    """``aperture_weights`` at place k of n, as an expression."""
    place = -1 + 2 * k / max(n - 1, 1)
    kinds = {
        "GAUSSIAN": lambda: F.exp(-0.5 * (2.5 * place) * (2.5 * place)),
        "X4": lambda: 1 / (1 + F.pow(2 * place, F.lit(4.0))),
        "HAMMING": lambda: 0.54 + 0.46 * F.cos(math.pi * place),
        "COSINE": lambda: 0.5 + 0.5 * F.cos(math.pi * place / 2),
        "NONE": lambda: F.lit(1.0),
    }
    if kind.upper() not in kinds:
        raise ValueError(f"unknown filter {kind}")
    return kinds[kind.upper()]()


def weighted_aperture(px: DataFrame, kind: str, n_rows: int, n_cols: int, rows: bool = True, cols: bool = True) -> DataFrame:
    """Samples of the aperture times weights on one or both axes."""
    weight = _weight(kind if rows else "NONE", F.col("r"), n_rows) * _weight(kind if cols else "NONE", F.col("c"), n_cols)
    return px.withColumn("re", F.col("re") * weight).withColumn("im", F.col("im") * weight)


def reramped(lines: DataFrame, chirp_rate: float, sample_rate: float, bandwidth: float) -> DataFrame:
    """Pulses without their mean, resampled to hold the chirp, times the chirp."""

    def kernel(z: np.ndarray) -> np.ndarray:
        z = z - z.mean(axis=1, keepdims=True)
        n = z.shape[1]
        size = int(math.ceil(n * (bandwidth + sample_rate) / sample_rate))
        spectrum = np.zeros((len(z), size), complex)
        start = (size - n) // 2
        spectrum[:, start : start + n] = np.fft.fftshift(np.fft.fft(z, axis=1), axes=1)
        wide = np.fft.ifft(np.fft.ifftshift(spectrum, axes=1), axis=1) * size / n
        t = (np.arange(size) - size / 2) * n / size / sample_rate
        return wide * np.exp(1j * np.pi * chirp_rate * t**2)

    return on_lines(lines, kernel)


def registration(one: DataFrame, two: DataFrame, upsample: int = 10) -> tuple[float, float]:
    """Rows and columns by which the second image (lines) is shifted against the first.

    The peak of the cross-correlation, found by transforms; then a small transform by
    matrices around the peak, upsampled. The cross spectrum of a chip is what reaches the
    driver, after the peak of the whole was found by the executors.
    """
    a, b = unpacked(transformed_2d(one, shift=False)), unpacked(transformed_2d(two, shift=False))
    both = a.join(b.select("r", "c", F.col("re").alias("br"), F.col("im").alias("bi")), ["r", "c"])
    cross = both.select("r", "c", (F.col("re") * F.col("br") + F.col("im") * F.col("bi")).alias("re"), (F.col("re") * F.col("bi") - F.col("im") * F.col("br")).alias("im"))
    size = cross.agg(F.max("r") + 1, F.max("c") + 1).first()
    m, n = size[0], size[1]
    power = unpacked(transformed_2d(packed(cross), sign=1, shift=False)).withColumn("p", F.col("re") ** 2 + F.col("im") ** 2)
    peak = power.agg(F.max_by(F.struct("r", "c"), "p")).first()[0]
    r0, c0 = (peak.r if peak.r <= m // 2 else peak.r - m), (peak.c if peak.c <= n // 2 else peak.c - n)
    # Refine: sums of the cross spectrum at shifts around the peak, made by the executors.
    near = np.arange(-upsample, upsample + 1) / upsample

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(near), len(near)), complex)
        for x in batches:
            fr = np.where(x.r > m // 2, x.r - m, x.r) / m
            fc = np.where(x.c > n // 2, x.c - n, x.c) / n
            z = x.re.to_numpy() + 1j * x.im.to_numpy()
            total += np.einsum("k,ki,kj->ij", z, np.exp(2j * np.pi * np.outer(fr, r0 + near)), np.exp(2j * np.pi * np.outer(fc, c0 + near)))
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "re": total.real.ravel(), "im": total.imag.ravel()})

    parts = cross.mapInPandas(sums, "i long, j long, re double, im double").groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    best = parts.agg(F.max_by(F.struct("i", "j"), F.col("re") ** 2 + F.col("im") ** 2)).first()[0]
    return float(r0 + near[best.i]), float(c0 + near[best.j])


def resampled(points: DataFrame, image: DataFrame) -> DataFrame:
    """Amplitudes of an image at fractional places (r, c) of it, bilinear; 0 beyond it."""
    from .geometry import bilinear

    grid = image.select(F.col("r").alias("ilat"), F.col("c").alias("ilon"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("a"))
    keyed = points.withColumnRenamed("r", "lat").withColumnRenamed("c", "lon")
    out = bilinear(keyed, grid, 1.0, "a")
    return out.withColumnRenamed("lat", "r").withColumnRenamed("lon", "c").withColumn("a", F.coalesce("a", F.lit(0.0)))
