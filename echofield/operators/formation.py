"""Image formation from pulse tables.

A pulse is a row with its positions and its samples, packed. Kernels run over Arrow
batches; partial images are sums, so Spark adds them up before and after the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import poly
from ..functions.geodesy import LIGHT, normal
from ..functions.vectors import Vec, vec
from .spectral import on_lines, padded_inverse, turned


def bistatic_position(tx: Vec, rcv: Vec, srp: Vec) -> tuple[Vec, Column]:
    """The equivalent monostatic position and the frequency scale cos(beta / 2)."""
    t, r = tx - srp, rcv - srp
    bisector = (t.unit() + r.unit()).unit()
    half = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t.unit().dot(r.unit())))) / 2
    return srp + bisector * ((t.norm() + r.norm()) / 2), F.cos(half)


def on_image_plane(position: Vec, focus_normal: Vec, scp: Vec, plane_normal: Vec) -> Vec:
    """Along the focus plane's normal to the image plane."""
    return position + focus_normal * ((scp - position).dot(plane_normal) / focus_normal.dot(plane_normal))


def polar_coordinates(pulses: DataFrame, reference: tuple[float, float, float], scp: tuple[float, float, float], plane_normal: tuple[float, float, float], focus_normal: tuple[float, float, float]) -> DataFrame:
    """vec, k_a (polar angle) and k_sf (frequency scale) of each pulse.

    reference: the position at the centre of the aperture.
    """
    lit = lambda v: Vec(*[F.lit(float(x)) for x in v])
    s, n, f = lit(scp), lit(plane_normal), lit(focus_normal)
    flat = on_image_plane(vec("tx"), f, s, n)
    x_axis = (on_image_plane(lit(reference), f, s, n) - s).unit()
    y_axis = x_axis.cross(n)
    out = flat - s
    sin_graze, sin_plane = (vec("tx") - s).unit().dot(f), out.unit().dot(f)
    scale = F.sqrt(1 - sin_graze * sin_graze) / F.sqrt(1 - sin_plane * sin_plane)
    return pulses.select("vec", (-F.atan2(out.dot(y_axis), out.dot(x_axis))).alias("k_a"), scale.alias("k_sf"))


def resolution_extent(pulses: DataFrame, samples: int) -> DataFrame:
    """One row: extent and resolution in range and across it, from the first and last pulse."""
    sight = (vec("tx") - vec("srp")).unit()
    rows = pulses.select("vec", "sc0", "scss", sight.x.alias("x"), sight.y.alias("y"), sight.z.alias("z"))
    ends = rows.agg(F.min_by(F.struct("x", "y", "z"), "vec").alias("a"), F.max_by(F.struct("x", "y", "z"), "vec").alias("b"), F.avg("sc0").alias("sc0"), F.avg("scss").alias("scss"), F.count(F.lit(1)).alias("n"))
    cosine = F.col("a.x") * F.col("b.x") + F.col("a.y") * F.col("b.y") + F.col("a.z") * F.col("b.z")
    ends = ends.withColumn("angle", F.acos(F.least(F.lit(1.0), cosine))).withColumn("centre", F.col("sc0") + F.col("scss") * (samples - 1) / 2)
    return ends.select(
        (LIGHT / (2 * F.col("scss"))).alias("range_extent"),
        (LIGHT / (2 * (F.col("angle") / F.col("n")) * F.col("centre"))).alias("cross_extent"),
        (LIGHT / (2 * F.col("scss") * samples)).alias("range_resolution"),
        (LIGHT / (2 * F.col("angle") * F.col("centre"))).alias("cross_resolution"),
    )


def selected(pulses: DataFrame, resolution: float, samples: int) -> tuple[DataFrame, int, int]:
    """Pulses and the range of samples that give a resolution, centred.

    The pulses are those within half the needed angle of the middle one.
    """
    ends = pulses.agg(F.avg("sc0").alias("sc0"), F.avg("scss").alias("scss"), F.min("vec").alias("a"), F.max("vec").alias("b")).first()
    wanted = min(samples, max(1, math.ceil(0.886 * LIGHT / (2 * resolution) / ends["scss"])))
    first = (samples - wanted) // 2
    centre = ends["sc0"] + ends["scss"] * (samples - 1) / 2
    angle = 0.886 * LIGHT / (2 * resolution * centre)
    sight = (vec("tx") - vec("srp")).unit()
    middle = pulses.where(F.col("vec") == (ends["a"] + ends["b"]) // 2).select(sight.x.alias("mx"), sight.y.alias("my"), sight.z.alias("mz"))
    cosine = sight.x * F.col("mx") + sight.y * F.col("my") + sight.z * F.col("mz")
    kept = pulses.join(F.broadcast(middle)).where(F.acos(F.least(F.lit(1.0), cosine)) <= angle / 2).drop("mx", "my", "mz")
    return kept, first, first + wanted


def scaled(pulses: DataFrame) -> DataFrame:
    """Samples times their pulse's amplitude scale."""
    z = F.transform("z", lambda x: F.struct((x["re"] * F.col("amp_sf")).alias("re"), (x["im"] * F.col("amp_sf")).alias("im")))
    return pulses.withColumn("z", z)


def backprojection(signals: DataFrame, pixels: list[tuple[int, int, float, float, float]], tile: int = 4096) -> DataFrame:
    """(r, c, re, im). signals: tx_x.., srp_x.., sc0, scss, z; pixels: (r, c, x, y, z).

    Every task adds its pulses up to one partial image, so what is shuffled is the image
    times the number of tasks, never pulses times pixels. The pixel grid is sent with the
    task and is as large as the image chip that is wanted.
    """
    r, c, x, y, z = (np.array(v) for v in zip(*pixels, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image = np.zeros(len(x), complex)
        for batch in batches:
            for p in batch.itertuples():
                raw = np.array([complex(s["re"], s["im"]) for s in p.z])
                size = 2 ** (3 + math.ceil(math.log2(len(raw))))
                profile = np.fft.fftshift(np.fft.ifft(raw, size))
                swath = LIGHT / p.scss
                ranges = np.linspace(-size / 2, size / 2 - 1, size) * swath / size
                to_srp = math.dist((p.tx_x, p.tx_y, p.tx_z), (p.srp_x, p.srp_y, p.srp_z))
                for k in range(0, len(x), tile):
                    part = slice(k, k + tile)
                    d = 2 * (np.sqrt((p.tx_x - x[part]) ** 2 + (p.tx_y - y[part]) ** 2 + (p.tx_z - z[part]) ** 2) - to_srp)
                    inside = (d > ranges[0]) & (d < ranges[-1])
                    value = np.interp(d, ranges, profile.real) + 1j * np.interp(d, ranges, profile.imag)
                    image[part] += np.where(inside, value * np.exp(2j * np.pi * p.sc0 / LIGHT * d), 0)
        yield pd.DataFrame({"r": r, "c": c, "re": image.real, "im": image.imag})

    parts = signals.select(*[f"{n}_{a}" for n in ("tx", "srp") for a in "xyz"], "sc0", "scss", "z").mapInPandas(run, "r long, c long, re double, im double")
    return parts.groupBy("r", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def range_azimuth(lines: DataFrame, rate: float = 1.0) -> DataFrame:
    """Range-azimuth compression: a padded inverse transform along each axis."""
    return turned(padded_inverse(turned(padded_inverse(lines, rate)), rate))


def polar_format(signals: DataFrame, polar: DataFrame, rate: float = 1.0) -> DataFrame:
    """Lines of the image from pulses (vec, sc0, scss, z) and their polar coordinates.

    Samples lie on rays of the frequency plane. They are interpolated to a rectangle that
    all rays cross, first along each ray, then across the rays, and transformed back.
    """
    rows = signals.join(polar, "vec")
    n = F.size("z")
    near, far = F.col("sc0") * F.col("k_sf") * F.cos("k_a"), (F.col("sc0") + F.col("scss") * (n - 1)) * F.col("k_sf") * F.cos("k_a")
    box = rows.agg(F.max(near).alias("low"), F.min(far).alias("high"), F.min("k_a").alias("first"), F.max("k_a").alias("last"), F.max(n).alias("n"), F.count(F.lit(1)).alias("m")).first()
    low, high, size, count = box["low"], box["high"], box["n"], box["m"]
    side = low * math.tan(min(-box["first"], box["last"])) if box["first"] < 0 < box["last"] else low * math.tan((box["last"] - box["first"]) / 2)

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.linspace(low, high, size)
        for batch in batches:
            out = []
            for p in batch.itertuples():
                raw = np.array([complex(s["re"], s["im"]) for s in p.z])
                at = (p.sc0 + p.scss * np.arange(len(raw))) * p.k_sf * math.cos(p.k_a)
                value = np.interp(wanted, at, raw.real, 0, 0) + 1j * np.interp(wanted, at, raw.imag, 0, 0)
                out += [(k, p.k_a, v.real, v.imag) for k, v in enumerate(value)]
            yield pd.DataFrame(out, columns=["k", "k_a", "re", "im"])

    def across(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k_a")
        v = low + (high - low) * group["k"].iloc[0] / max(size - 1, 1)
        at = v * np.tan(group["k_a"].to_numpy())
        wanted = np.linspace(-side, side, count)
        value = np.interp(wanted, at, group["re"], 0, 0) + 1j * np.interp(wanted, at, group["im"], 0, 0)
        back = np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(np.pad(value, (0, int(count * rate) - count)))))
        return pd.DataFrame({"r": np.full(len(back), group["k"].iloc[0]), "c": np.arange(len(back)), "re": back.real, "im": back.imag})

    grid = rows.select("sc0", "scss", "k_a", "k_sf", "z").mapInPandas(along, "k long, k_a double, re double, im double")
    by_sample = grid.groupBy("k").applyInPandas(across, "r long, c long, re double, im double")
    from .spectral import packed

    return turned(padded_inverse(packed(by_sample, by="c", along="r"), rate))


def range_deskewed(lines: DataFrame, chirp_rate: float, sample_rate: float) -> DataFrame:
    """Removes residual video phase: a quadratic phase over each pulse's spectrum."""

    def kernel(z: np.ndarray) -> np.ndarray:
        f = np.fft.fftfreq(z.shape[1], 1 / sample_rate)
        return np.fft.ifft(np.fft.fft(z, axis=1) * np.exp(-1j * np.pi * f**2 / chirp_rate), axis=1)

    return on_lines(lines, kernel)


def fitted_polynomial(df: DataFrame, x: str, ys: list[str], order: int) -> list[list[float]]:
    """Least squares coefficients, ascending, by sums of powers.

    x is centred and scaled before, so that the equations stay well conditioned.
    """
    span = df.agg(F.avg(x), F.stddev_pop(x)).first()
    centre, scale = span[0] or 0.0, span[1] or 1.0
    u = (F.col(x) - centre) / scale
    sums = df.agg(*[F.sum(F.pow(u, F.lit(float(k)))).alias(f"s{k}") for k in range(2 * order + 1)], *[F.sum(F.pow(u, F.lit(float(k))) * F.col(y)).alias(f"{y}_{k}") for y in ys for k in range(order + 1)]).first()
    matrix = np.array([[sums[f"s{i + j}"] for j in range(order + 1)] for i in range(order + 1)])
    out = []
    for y in ys:
        fitted = np.polynomial.Polynomial(np.linalg.solve(matrix, [sums[f"{y}_{k}"] for k in range(order + 1)]))
        moved = fitted(np.polynomial.Polynomial([-centre / scale, 1 / scale]))
        out.append([float(v) for v in np.pad(moved.coef, (0, order + 1 - len(moved.coef)))])
    return out


#: Orders that a series is fitted with, until it is near enough.
ORDERS = (5, 8, 12, 16, 24, 32, 48)


def fitted_series(df: DataFrame, x: str, ys: list[str], miss: float) -> tuple[float, float, list[list[float]]]:
    """Centre and half-width of x, and for each y its least squares coefficients of Chebyshev polynomials.

    The order is the least of ORDERS that misses no y by more than ``miss``, or else the
    best one; a long arc needs a higher one than a short arc. It stays under twice the root of the number
    of rows, up to which fits over even steps are well conditioned. What a fit leaves is fitted once more, against rounding.
    """
    low, high, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not n:
        raise ValueError("nothing to fit")
    centre, half = (low + high) / 2, (high - low) / 2 or 1.0
    orders = [k for k in ORDERS if k <= 2 * n**0.5 and k < n] or [min(ORDERS[0], n - 1)]
    u = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(x) - centre) / half))

    def solved(values: list[Column], most: int) -> list[list[list[float]]]:
        """Coefficients of each value, for each order up to most."""
        based = df.select(F.acos(u).alias("_angle"), *[v.alias(f"_{k}") for k, v in enumerate(values)])
        basis = [F.cos(F.col("_angle") * k) for k in range(2 * most + 1)]
        sums = based.agg(*[F.sum(b).alias(f"s{k}") for k, b in enumerate(basis)], *[F.sum(basis[k] * F.col(f"_{j}")).alias(f"v{j}_{k}") for j in range(len(values)) for k in range(most + 1)]).first()
        out = []
        for order in (k for k in orders if k <= most):
            matrix = np.array([[(sums[f"s{i + j}"] + sums[f"s{abs(i - j)}"]) / 2 for j in range(order + 1)] for i in range(order + 1)])
            out.append([np.linalg.solve(matrix, [sums[f"v{j}_{k}"] for k in range(order + 1)]).tolist() for j in range(len(values))])
        return out

    tried = solved([F.col(y) for y in ys], orders[-1])
    value = lambda c: poly.chebyshev(F.array(*map(F.lit, c)), u)
    misses = df.agg(*[F.max(F.greatest(F.lit(0.0), *[F.abs(F.col(y) - value(c)) for y, c in zip(ys, fits, strict=True)])) for fits in tried]).first()
    best = next((k for k, m in enumerate(misses) if m <= miss), int(np.argmin(misses)))
    left = solved([F.col(y) - value(c) for y, c in zip(ys, tried[best], strict=True)], orders[best])[-1]
    return centre, half, [[a + b for a, b in zip(c, d, strict=True)] for c, d in zip(tried[best], left, strict=True)]


def velocity(pulses: DataFrame) -> DataFrame:
    """vec and the finite difference of the position to the next pulse."""
    order = Window.partitionBy("channel").orderBy("tx_time")
    dt = F.lead("tx_time").over(order) - F.col("tx_time")
    return pulses.select("channel", "vec", *[((F.lead(f"tx_{a}").over(order) - F.col(f"tx_{a}")) / dt).alias(f"v_{a}") for a in "xyz"])


def slant_plane(arp: Vec, velocity_: Vec, scp: Vec) -> Vec:
    """Unit normal of the slant plane, upward."""
    n = velocity_.cross(scp - arp).unit()
    return n * F.signum(n.dot(normal(scp)))
