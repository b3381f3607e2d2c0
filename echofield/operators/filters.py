"""Speckle filters, apodisation and phase gradients."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_statistics(px: DataFrame, half: int) -> DataFrame:
    """Intensity with its mean and variance over windows that shrink at the edges."""
    power = px.select("r", "c", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("i"))
    power = power.withColumn("i2", F.col("i") * F.col("i")).withColumn("n", F.lit(1.0))
    down = Window.partitionBy("c").orderBy("r").rangeBetween(-half, half)
    along = Window.partitionBy("r").orderBy("c").rangeBetween(-half, half)
    first = power.select("r", "c", "i", *[F.sum(x).over(down).alias(s) for x, s in (("i", "s"), ("i2", "q"), ("n", "m"))])
    sums = first.select("r", "c", "i", *[F.sum(x).over(along).alias(x) for x in ("s", "q", "m")])
    mean = F.col("s") / F.col("m")
    variance = F.greatest(F.lit(0.0), F.col("q") / F.col("m") - mean * mean)
    return sums.select("r", "c", "i", "s", mean.alias("mean"), variance.alias("variance"))


def _ratio() -> Column:
    """Squared coefficient of variation."""
    return F.when(F.col("mean") > 0, F.col("variance") / (F.col("mean") * F.col("mean"))).otherwise(0.0)


def looks(local: DataFrame, half: int, n_rows: int, n_cols: int, share: float = 0.1) -> DataFrame:
    """One row: the number of looks, from the most even tenth of the interior."""
    inside = F.col("r").between(half, n_rows - 1 - half) & F.col("c").between(half, n_cols - 1 - half)
    ratios = local.where(inside).select(_ratio().alias("ratio"))
    edge = ratios.agg(F.percentile("ratio", F.lit(share)).alias("edge"))
    return ratios.join(F.broadcast(edge)).where(F.col("ratio") <= F.col("edge")).agg((1 / F.avg("ratio")).alias("looks"))


def speckle(px: DataFrame, kind: str, half: int = 2, n_looks: float = 1.0) -> DataFrame:
    """r, c, amplitude. Windows shrink at the edges; boxcar's are padded with zeros.

    The result's mean intensity is the image's.
    """
    local = local_statistics(px, half)
    i, mean, ratio = F.col("i"), F.col("mean"), _ratio()
    noise = 1 / n_looks
    if kind == "boxcar":
        value = F.col("s") / (2 * half + 1) ** 2
    elif kind in ("lee", "kuan"):
        texture = ratio - noise if kind == "lee" else (ratio - noise) / (1 + noise)
        texture = F.greatest(texture, F.lit(1e-20))
        value = mean + (i - mean) * F.least(F.lit(1.0), texture / F.greatest(ratio, F.lit(1e-20)))
    elif kind == "map":
        texture = F.greatest((ratio - noise) / (1 + noise), F.lit(1e-20))
        b = mean / texture - n_looks - 1
        root = (b + F.sqrt(b * b + 4 * n_looks * i * mean / texture)) * texture / 2
        value = F.when((ratio >= noise) & (texture <= 1 / (1 + n_looks)), root).otherwise(i)
    else:
        raise ValueError(f"unknown filter {kind}")
    return _unbiased(local.select("r", "c", "i", value.alias("filtered")))


def _unbiased(filtered: DataFrame) -> DataFrame:
    scale = filtered.agg((F.avg("i") / F.avg("filtered")).alias("scale"))  # one row
    value = F.col("filtered") * F.col("scale")
    return filtered.join(F.broadcast(scale)).select("r", "c", F.sqrt(F.greatest(value, F.lit(0.0))).alias("amplitude"))


def gathered(px: DataFrame, half: int, columns: list[str]) -> DataFrame:
    """r, c, near: for each pixel an array of (r, c, columns) of the places around it.

    A window's lines are gathered column by column, then its columns line by line, so
    each pixel is shuffled twice, whatever the window's size.
    """
    down, along = (Window.partitionBy(x).orderBy(y).rangeBetween(-half, half) for x, y in (("c", "r"), ("r", "c")))
    lines = px.select("r", "c", F.collect_list(F.struct("r", "c", *columns)).over(down).alias("near"))
    return lines.select("r", "c", F.flatten(F.collect_list("near").over(along)).alias("near"))


#: Lines and columns of a tile.
TILE = 512


def _strips(image: DataFrame) -> DataFrame:
    """r, c, i: a line's places and intensities, from long-form pixels (r, c, re, im) or, without a shuffle, from packed lines (r, z)."""
    power = lambda x: x["re"] * x["re"] + x["im"] * x["im"]
    if "z" in image.columns:
        at = F.when(F.size("z") > 0, F.sequence(F.lit(0), F.size("z") - 1)).otherwise(F.array().cast("array<int>"))
        return image.select("r", at.alias("c"), F.transform("z", power).alias("i"))
    cell = F.struct(F.col("c").cast("int").alias("c"), power({"re": F.col("re"), "im": F.col("im")}).alias("i"))
    lines = image.groupBy("r").agg(F.collect_list(cell).alias("p"))
    return lines.select("r", F.col("p.c").alias("c"), F.col("p.i").alias("i"))


def _tiles(image: DataFrame, halo: int) -> tuple[DataFrame, int]:
    """tr, tc, r, c, i: strips, each sent to the tiles that lie within ``halo`` of it; and a tile's size."""
    size = max(TILE, 4 * halo)

    def reached(low: Column, high: Column) -> Column:
        # No tile is made for the halo before place 0.
        first = F.greatest(F.floor((low - halo) / size), F.when(low >= 0, F.lit(0).cast("long")))
        return F.explode(F.sequence(first, F.floor((high + halo) / size)))

    strips = _strips(image).where(F.size("c") > 0)
    each = strips.withColumn("tr", reached(F.col("r"), F.col("r"))).withColumn("tc", reached(F.array_min("c"), F.array_max("c")))
    left = F.col("tc") * size - halo
    whole = (F.array_min("c") >= left) & (F.array_max("c") < left + size + 2 * halo)
    cut = F.filter(F.arrays_zip("c", "i"), lambda x: (x["c"] >= left) & (x["c"] < left + size + 2 * halo))
    each = each.select("tr", "tc", "r", F.when(whole, F.col("c")).otherwise(cut["c"]).alias("c"), F.when(whole, F.col("i")).otherwise(cut["i"]).alias("i"))
    return each.where(F.size("c") > 0), size


class _Tile:
    """A tile with its halo as arrays with a margin: intensities, and where there are pixels; places without one hold 0."""

    def __init__(self, table: pa.Table, size: int, margin: int):
        places, values = (table.column(x).combine_chunks() for x in ("c", "i"))
        self.c = places.flatten().to_numpy().astype(np.int64)
        self.r = np.repeat(table.column("r").to_numpy(), places.value_lengths().to_numpy())
        self.power = values.flatten()
        self.at = self.r - self.r.min() + margin, self.c - self.c.min() + margin
        shape = [int(x.max()) + 1 + margin for x in self.at]
        self.margin, self.i, self.n = margin, np.zeros(shape), np.zeros(shape)
        # A pixel without a value counts as a place and adds nothing.
        self.i[self.at] = self.power.fill_null(0.0).to_numpy()
        self.n[self.at] = 1.0
        tr, tc = (table.column(x)[0].as_py() for x in ("tr", "tc"))
        self.own = (self.r // size == tr) & (self.c // size == tc)

    def shifted(self, x: np.ndarray, dr: int, dc: int) -> np.ndarray:
        m = self.margin
        return x[m + dr : x.shape[0] - m + dr, m + dc : x.shape[1] - m + dc]

    def inner(self, x: np.ndarray) -> np.ndarray:
        """The tile's own pixels of an array without margin."""
        return x[self.at[0] - self.margin, self.at[1] - self.margin][self.own]

    def ratio(self, half: int) -> np.ndarray:
        """As ``_ratio`` of ``local_statistics``; without margin."""
        sums = []
        for x in (self.i, self.i * self.i, self.n):
            down = np.zeros_like(x)
            for d in range(-half, half + 1):
                low, high = max(0, -d), x.shape[0] - max(0, d)
                down[low:high] += x[low + d : high + d]
            sums.append(sum(self.shifted(down, 0, d) for d in range(-half, half + 1)))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = sums[0] / sums[2]
            return np.where(mean > 0, np.maximum(0.0, sums[1] / sums[2] - mean * mean) / (mean * mean), 0.0)

    def frost(self, half: int, damping: float, radius: int) -> np.ndarray:
        """Filtered intensities; without margin. Places equally far away have one weight, so are added up first."""
        decay, rings = damping * self.ratio(half), defaultdict(list)
        for dr in range(-radius, radius + 1):
            for dc in range(-radius, radius + 1):
                rings[dr * dr + dc * dc].append((dr, dc))
        total, weights = np.zeros_like(decay), np.zeros_like(decay)
        for square, places in sorted(rings.items()):
            weight = np.exp(-decay * math.sqrt(square))
            total += weight * sum(self.shifted(self.i, *d) for d in places)
            weights += weight * sum(self.shifted(self.n, *d) for d in places)
        with np.errstate(divide="ignore", invalid="ignore"):
            return total / weights


def frost_radius(image: DataFrame, half: int = 2, damping: float = 1.0, least: float = 0.01) -> int:
    """The half-width beyond which no weight of a Frost filter is over ``least``, on the diagonal.

    It comes from the least variation of the image's windows, one number.
    """
    tiles, size = _tiles(image, half)

    def smallest(table: pa.Table) -> pa.Table:
        tile = _Tile(table, size, half)
        return pa.table({"ratio": pa.array([np.fmin.reduce(tile.inner(tile.ratio(half)))] if tile.own.any() else [], pa.float64())})

    ratio = tiles.groupBy("tr", "tc").applyInArrow(smallest, "ratio double").agg(F.min("ratio")).first()[0]
    if not ratio:
        raise ValueError("an even image has no Frost radius; give one")
    return math.ceil(-math.log(least) / (math.sqrt(2) * damping * ratio))


def frost(image: DataFrame, half: int = 2, damping: float = 1.0, radius: int | None = None) -> DataFrame:
    """Neighbours weighted by exp(-damping * variation * distance); the image is pixels (r, c, re, im) or packed lines (r, z).

    The variation is that of windows of ``half``; neighbours within ``radius`` count, which
    is derived from the least variation if it isn't given. Lines are cut into strips that go to
    the tiles which they reach, so a task holds a tile and little more than the image is shuffled,
    whatever the radius. The mean of the result needs a pass of its own over the same tiles.
    """
    radius = frost_radius(image, half, damping) if radius is None else radius
    margin = max(radius, half)
    tiles, size = _tiles(image, margin)
    grouped = tiles.groupBy("tr", "tc")

    def sums(table: pa.Table) -> pa.Table:
        tile = _Tile(table, size, margin)
        known = tile.power.is_valid().to_numpy(zero_copy_only=False) & tile.own
        total = tile.i[tile.at][known].sum(), float(known.sum()), tile.inner(tile.frost(half, damping, radius)).sum(), float(tile.own.sum())
        return pa.table({x: pa.array([v], pa.float64()) for x, v in zip(("i", "known", "filtered", "n"), total, strict=True)})

    def values(table: pa.Table) -> pa.Table:
        tile = _Tile(table, size, margin)
        return pa.table({"r": tile.r[tile.own], "c": tile.c[tile.own], "filtered": tile.inner(tile.frost(half, damping, radius))})

    means = grouped.applyInArrow(sums, "i double, known double, filtered double, n double").agg(*(F.sum(x).alias(x) for x in ("i", "known", "filtered", "n")))
    scale = means.select((F.col("i") / F.col("known") / (F.col("filtered") / F.col("n"))).alias("scale"))  # one row
    value = F.col("filtered") * F.col("scale")
    return grouped.applyInArrow(values, "r long, c long, filtered double").join(F.broadcast(scale)).select("r", "c", F.sqrt(F.greatest(value, F.lit(0.0))).alias("amplitude"))


def apodised(px: DataFrame) -> DataFrame:
    """Spatially variant apodisation of I and Q, from the neighbours on both axes.

    Candidates are the sample alone and with the neighbours of either axis or of both;
    one of another sign than the sample gives 0, else that of least magnitude is taken.
    Borders give 0.
    """
    down, along = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")
    out = px
    for p in ("re", "im"):
        out = out.withColumn(f"v_{p}", F.lag(p).over(down) + F.lead(p).over(down))
    for p in ("re", "im"):
        out = out.withColumn(f"h_{p}", F.lag(p).over(along) + F.lead(p).over(along)).withColumn(f"d_{p}", F.lag(f"v_{p}").over(along) + F.lead(f"v_{p}").over(along))

    def chosen(p: str) -> Column:
        x, v, h, d = F.col(p), F.col(f"v_{p}"), F.col(f"h_{p}"), F.col(f"d_{p}")
        best, turns = x, F.lit(False)
        for option in (x + h / 2, x + v / 2, x + v / 2 + h / 2 + d / 4):
            turns = turns | (option * x < 0)
            best = F.when(F.abs(option) < F.abs(best), option).otherwise(best)
        return F.when(d.isNull() | turns, 0.0).otherwise(best)

    return out.select("r", "c", chosen("re").alias("re"), chosen("im").alias("im"))


def phase_derivative(lines: DataFrame, delta: float = 0.25) -> DataFrame:
    """r, c, xr, xi: each sample half a step of delta before, times the conjugate of that after it.

    Samples between samples come from a ramp on the line's transform. For the derivative
    down the columns turn the lines before and the result after.
    """
    from .spectral import on_lines, unpacked

    def kernel(z: np.ndarray) -> np.ndarray:
        n = z.shape[1]
        ramp = np.exp(1j * np.pi * delta * np.fft.fftshift(np.arange(n) - n / 2) / n)
        spectrum = np.fft.fft(z, axis=1)
        return np.fft.ifft(spectrum * ramp.conj(), axis=1) * np.fft.ifft(spectrum * ramp, axis=1).conj()

    return unpacked(on_lines(lines, kernel)).select("r", "c", F.col("re").alias("xr"), F.col("im").alias("xi"))


def phase_gradient(lines: DataFrame, half: int = 2, delta: float = 0.25) -> DataFrame:
    """r, c, gradient: phase change per sample along the lines, mean over a window."""
    from .raster import window_sums

    return window_sums(phase_derivative(lines, delta), ["xr", "xi"], half, half).select("r", "c", (F.atan2("xi", "xr") / delta).alias("gradient"))


def phase_gradient_median(lines: DataFrame, half: int = 1, delta: float = 0.25) -> DataFrame:
    """As phase_gradient with medians of the real and imaginary parts, zero outside."""
    size = (2 * half + 1) ** 2
    near = gathered(phase_derivative(lines, delta), half, ["xr", "xi"])
    near = near.select("r", "c", F.transform("near", lambda v: v["xr"]).alias("xr"), F.transform("near", lambda v: v["xi"]).alias("xi"))

    def median(name: str) -> Column:
        padded = F.concat(F.col(name), F.array_repeat(F.lit(0.0), size - F.size(name)))
        return F.element_at(F.array_sort(padded), size // 2 + 1)

    return near.select("r", "c", (F.atan2(median("xi"), median("xr")) / delta).alias("gradient"))
