"""What an image viewer asks for: a window of an image at a scale, remapped, and its coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import display


def window(centre: float, size: int, whole: int, scale: int) -> tuple[int, int]:
    """First and last place, counted from 1, that a view of size places at a scale shows."""
    first = max(1, int(centre - scale * (size - 1) / 2 + 0.5))
    last = first + scale * size - 1
    if last > whole:
        first, last = max(1, whole + 1 - scale * size), whole
    return first, last


def shown(px: DataFrame, n_rows: int, n_cols: int, centre: tuple[float, float], size: tuple[int, int], scale: int, remap: Callable[[Column, Column], Column] = display.density) -> DataFrame:
    """r, c, value (0 to 255) of a view, places counted from 0 within it.

    Each place is the first sample of its block. remap is any function of the amplitude
    and the view's mean amplitude.
    """
    (top, bottom), (left, right) = (window(c, s, n, scale) for c, s, n in zip(centre, size, (n_rows, n_cols), strict=True))
    inside = F.col("r").between(top - 1, bottom - 1) & F.col("c").between(left - 1, right - 1)
    first = ((F.col("r") - top + 1) % scale == 0) & ((F.col("c") - left + 1) % scale == 0)
    a = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    view = px.where(inside & first).select(F.floor((F.col("r") - top + 1) / scale).alias("r"), F.floor((F.col("c") - left + 1) / scale).alias("c"), a.alias("a"))
    mean = view.agg(F.avg("a").alias("mean"))  # one row
    return view.join(F.broadcast(mean)).select("r", "c", display.byte(remap(F.col("a"), F.col("mean"))).alias("value"))


def to_native(place: Column, origin: Column, scale: Column) -> Column:
    """A place on the axes as one of the image, both counted from 1."""
    return F.when(scale < 1, place + origin - 1).otherwise(scale * (place - 1) + origin)


def to_axes(place: Column, origin: Column, scale: Column) -> Column:
    return F.when(scale < 1, place - origin + 1).otherwise((place - origin) / scale + 1)


def registry(lines: DataFrame) -> DataFrame:
    """name, call, kind, selected, polarimetric from lines of a comma-separated list of algorithms; column ``line``."""
    names = ("name", "call", "kind", "selected", "polarimetric")
    parts = F.split("line", ",")
    return lines.select(*[F.trim(F.get(parts, k)).alias(n) for k, n in enumerate(names)])
