"""Estimates from pixels, and small summaries of catalogs and texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import poly
from .spectral import on_lines, transformed, unpacked


def region_statistics(px: DataFrame, regions: DataFrame, guard: int, calibrated: bool = False) -> DataFrame:
    """roi, average, least, greatest in decibels.

    regions: roi, r0, r1, c0, c1, a table of a user's regions. average is of the region's
    whole power; least and greatest are of the power of its lines within the guard band.
    Without calibration all are relative to the region of least power.
    """
    inside = F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))
    # Regions are drawn by hand; the condition on lines comes first.
    lines = px.join(F.broadcast(regions), inside).groupBy("roi", "r0", "r1", "r").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
    kept = F.when(F.col("r").between(F.col("r0") + guard, F.col("r1") - guard), F.col("power"))
    each = lines.groupBy("roi").agg(F.sum("power").alias("total"), F.min(kept).alias("low"), F.max(kept).alias("high"))
    base = F.lit(1.0) if calibrated else F.min("total").over(Window.partitionBy(F.lit(0)))
    decibels = lambda x: 10 * F.log10(F.col(x) / F.col("base"))
    return each.withColumn("base", base).select("roi", decibels("total").alias("average"), decibels("low").alias("least"), decibels("high").alias("greatest"))


def noise(px: DataFrame, height: int, width: int, coefficients: Column, spacing: tuple[float, float], centre: tuple[int, int]) -> DataFrame:
    """tile_r, tile_c, measured, predicted: noise of each tile in decibels, and the polynomial's at its middle.

    coefficients[m][n] are of metres from the centre to the powers m and n.
    """
    tiles = px.groupBy(F.floor(F.col("r") / height).alias("tile_r"), F.floor(F.col("c") / width).alias("tile_c"))
    found = tiles.agg((10 * F.log10(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")))).alias("measured"), ((F.min("r") + F.max("r")) / 2).alias("mid_r"), ((F.min("c") + F.max("c")) / 2).alias("mid_c"))
    x, y = (F.col("mid_r") - centre[0]) * spacing[0], (F.col("mid_c") - centre[1]) * spacing[1]
    return found.select("tile_r", "tile_c", "measured", poly.polyval2d(coefficients, x, y).alias("predicted"))


def spectrum_weights(lines: DataFrame) -> DataFrame:
    """k, weight: sum over all lines of the spectrum's magnitude in each bin."""
    spectrum = unpacked(transformed(lines))
    return spectrum.groupBy(F.col("c").alias("k")).agg(F.sum(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("weight"))


def fitted_weights(weights: list[float], oversample: float = 1.0) -> tuple[bool, np.ndarray]:
    """Whether a raised cosine fits the support better than a line, and the cosine, its largest value 1.

    weights: one number for each bin of a line, so it is short.
    """
    all_, trim = np.array(weights), int(len(weights) / oversample / 2)
    support = np.concatenate([all_[:trim], all_[len(all_) - trim - 1 :]])
    n, places = len(support), np.arange(len(support))
    spectrum = np.fft.fft(support)
    # The mean and the first harmonic, centred.
    cosine = (np.abs(spectrum[0]) + 2 * np.abs(spectrum[1]) * np.cos(2 * np.pi * places / n)) / n
    line = np.polyval(np.polyfit(places + 1, support, 1), places + 1)
    return bool(np.linalg.norm(cosine - support) < np.linalg.norm(line - support)), cosine / cosine.max()


def sampled_mean(px: DataFrame, n_rows: int, n_cols: int, most: int = 1000) -> DataFrame:
    """One row: the mean magnitude of finite samples, of at most about most x most places."""
    every_r, every_c = max(1, -(-n_rows // most)), max(1, -(-n_cols // most))
    magnitude = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    chosen = px.where((F.col("r") % every_r == 0) & (F.col("c") % every_c == 0)).select(magnitude.alias("a"))
    return chosen.where(~F.isnan("a") & (F.col("a") < float("inf"))).agg(F.avg("a").alias("mean"))


def sinc_interpolated(lines: DataFrame, places: np.ndarray, spacing: float = 1.0) -> DataFrame:
    """Lines at other places (in samples times spacing), by a sinc over all samples."""

    def kernel(z: np.ndarray) -> np.ndarray:
        at = np.arange(z.shape[1]) * spacing
        return z @ np.sinc((places[None, :] - at[:, None]) / spacing)

    return on_lines(lines, kernel)


def gaps(rows: DataFrame, key: str, at: str) -> DataFrame:
    """key, least, greatest, backward: steps between a key's values in order of ``place``."""
    step = F.lead(at).over(Window.partitionBy(key).orderBy("place")) - F.col(at)
    each = rows.withColumn("step", step)
    return each.groupBy(key).agg(F.min("step").alias("least"), F.max("step").alias("greatest"), F.coalesce(F.sum((F.col("step") <= 0).cast("long")), F.lit(0)).alias("backward"))


def collector_summary(collects: DataFrame) -> DataFrame:
    """collector, side, polarisations: the most frequent side, of equals the first, and how many polarisations."""
    sides = collects.groupBy("collector", "side").agg(F.count(F.lit(1)).alias("n"), F.collect_set("pol").alias("pols"))
    most = F.max_by("side", F.struct("n", -F.ascii("side")))
    return sides.groupBy("collector").agg(most.alias("side"), F.size(F.array_distinct(F.flatten(F.collect_list("pols")))).alias("polarisations"))


def field_differences(present: Column, schema: list[str]) -> dict[str, Column]:
    """Field names that both have, and those that one of them lacks."""
    known = F.array(*map(F.lit, schema))
    names = {"known": F.array_intersect(known, present), "missing": F.array_except(known, present), "unknown": F.array_except(present, known)}
    return {k: F.array_join(F.array_sort(v), ",") for k, v in names.items()}


def visible_fields(df: DataFrame, config: dict[str, bool]) -> DataFrame:
    """The columns that a configuration of flags doesn't hide."""
    return df.select(*[x for x in df.columns if config.get(x, True)])


def split_time(text: Column) -> tuple[Column, Column]:
    """Whole seconds since 1970 and the rest of a date and time with any number of digits.

    The two parts keep what one number would lose. A T or Z is a blank.
    """
    plain = F.trim(F.translate(text, "TZ", "  "))
    whole = F.unix_timestamp(F.substring_index(plain, ".", 1), "yyyy-MM-dd HH:mm:ss")
    rest = F.when(F.contains(plain, F.lit(".")), F.concat(F.lit("0."), F.substring_index(plain, ".", -1)).cast("double")).otherwise(0.0)
    return whole, rest


def node_count(xml: Column, path: str) -> Column:
    return F.size(F.xpath(xml, F.lit(path)))


def decomposition(text: Column, names: tuple[str, ...]) -> dict[str, Column]:
    """Numbers from lines of name=value, in a fixed order."""
    lines = F.split(text, "\n")
    return {name: F.substring_index(F.get(lines, k), "=", -1).cast("double") for k, name in enumerate(names)}


def any_polygon(r: Column, c: Column, polygons: list[list[tuple[float, float]]]) -> Column:
    from .raster import in_polygon

    out = F.lit(False)
    for corners in polygons:
        out = out | in_polygon(r, c, corners)
    return out


def viewer_bands(df: DataFrame) -> DataFrame:
    """red, green, blue: magnitudes of the Pauli components of four bands, as a viewer shows them."""
    hh, hv, vh, vv = ((F.col(f"{x}_re"), F.col(f"{x}_im")) for x in ("hh", "hv", "vh", "vv"))
    size = lambda a, b: F.sqrt(a * a + b * b)
    red = size(hh[0] - vv[0], hh[1] - vv[1])
    green = size(hv[0] + vh[0], hv[1] + vh[1]) / 2
    blue = size(hh[0] + vv[0], hh[1] + vv[1])
    return df.select("r", "c", red.alias("red"), green.alias("green"), blue.alias("blue"))
