"""Scans, decimation, orientation and neighbourhood sums over long-form pixels.

An image is rows (r, c, re, im), with an optional frame or band column. Neighbourhood
sums are separable: a pass down the columns and one along the rows, so a window holds
one column or line at a time, never an image.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checked_range(first: int, last: int, size: int) -> tuple[int, int]:
    """A range within 0 .. size - 1, or an error."""
    if not 0 <= first <= last < size:
        raise ValueError(f"range {first}..{last} is not within 0..{size - 1}")
    return first, last


def area(px: DataFrame, rows: tuple[int, int], cols: tuple[int, int], stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """A rectangle (bounds included), with every k-th row and column from its start."""
    inside = F.col("r").between(*rows) & F.col("c").between(*cols)
    kept = ((F.col("r") - rows[0]) % stride[0] == 0) & ((F.col("c") - cols[0]) % stride[1] == 0)
    return px.where(inside & kept)


def subset(px: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A rectangle as an image of its own, which starts at (0, 0)."""
    return area(px, rows, cols).withColumn("r", F.col("r") - rows[0]).withColumn("c", F.col("c") - cols[0])


def decimated(px: DataFrame, rows: int, cols: int, how=F.max) -> DataFrame:
    """Amplitudes of distinct blocks, each reduced by an aggregate."""
    amplitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return px.groupBy(F.floor(F.col("r") / rows).alias("r"), F.floor(F.col("c") / cols).alias("c")).agg(how(amplitude).alias("amplitude"))


def oriented(px: DataFrame, n_rows: int, n_cols: int, flip_rows: bool = False, flip_cols: bool = False, transpose: bool = False) -> DataFrame:
    """Flips, then a transposition."""
    r = n_rows - 1 - F.col("r") if flip_rows else F.col("r")
    c = n_cols - 1 - F.col("c") if flip_cols else F.col("c")
    others = [x for x in px.columns if x not in ("r", "c")]
    return px.select((c if transpose else r).alias("r"), (r if transpose else c).alias("c"), *others)


def segments(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Row segments with their first rows, as one image."""
    moved = [px.withColumn("r", F.col("r") + first) for px, first in parts]
    return reduce(DataFrame.unionByName, moved)


def stacked(images: list[DataFrame]) -> DataFrame:
    """Images of one size as bands; a different size is an error."""
    sizes = [px.agg(F.max("r"), F.max("c")).first() for px in images]
    if any(tuple(x) != tuple(sizes[0]) for x in sizes):
        raise ValueError("images differ in size")
    return reduce(DataFrame.unionByName, [px.withColumn("band", F.lit(k)) for k, px in enumerate(images)])


def window_sums(px: DataFrame, columns: list[str], half_rows: int, half_cols: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Replaces each column by its sum over a window of odd size, zero outside."""
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-half_rows, half_rows)
    along = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-half_cols, half_cols)
    others = [x for x in px.columns if x not in columns]
    first = px.select(*others, *[F.sum(x).over(down).alias(x) for x in columns])
    return first.select(*others, *[F.sum(x).over(along).alias(x) for x in columns])


def sized_window_sums(px: DataFrame, columns: list[str], rows: int, cols: int) -> DataFrame:
    """Replaces each column by its sum over a window of any size, zero outside.

    A window of even size reaches one place further ahead than back.
    """
    reach = lambda n: (-(n - n // 2 - 1), n // 2)
    down = Window.partitionBy("c").orderBy("r").rangeBetween(*reach(rows))
    along = Window.partitionBy("r").orderBy("c").rangeBetween(*reach(cols))
    others = [x for x in px.columns if x not in columns]
    first = px.select(*others, *[F.sum(x).over(down).alias(x) for x in columns])
    return first.select(*others, *[F.sum(x).over(along).alias(x) for x in columns])


def prefix_window_sums(px: DataFrame, column: str, half: int, n_rows: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums down the columns from running sums: the cost doesn't grow with the window.

    The lines must be dense.
    """
    order = Window.partitionBy(*keys, "c").orderBy("r")
    running = F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = px.withColumn("_running", running)
    last = F.last("_running").over(order.rowsBetween(0, half))
    before = F.coalesce(F.lag("_running", half + 1).over(order), F.lit(0.0))
    return out.withColumn(column, last - before).drop("_running")


def running_mean(px: DataFrame, column: str, half_rows: int, half_cols: int, n_rows: int, n_cols: int, pad: Column | float = 0.0) -> DataFrame:
    """Means over windows of odd size; places outside the image count as ``pad``."""
    out = window_sums(px, [column], half_rows, half_cols)
    inside_rows = F.least(F.col("r") + half_rows, F.lit(n_rows - 1)) - F.greatest(F.col("r") - half_rows, F.lit(0)) + 1
    inside_cols = F.least(F.col("c") + half_cols, F.lit(n_cols - 1)) - F.greatest(F.col("c") - half_cols, F.lit(0)) + 1
    full = (2 * half_rows + 1) * (2 * half_cols + 1)
    return out.withColumn(column, (F.col(column) + (full - inside_rows * inside_cols) * pad) / full)


def in_polygon(r: Column, c: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule."""
    out = F.lit(False)
    for (r1, c1), (r2, c2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if r1 == r2:
            continue
        crosses = ((F.lit(float(r1)) > r) != (F.lit(float(r2)) > r)) & (c < (r - r1) * ((c2 - c1) / (r2 - r1)) + c1)
        out = out != crosses
    return out
