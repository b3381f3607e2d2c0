"""Polarimetric measures of pixels with columns hh_re .. vv_im."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx
from .raster import window_sums

NAMES = ("hh", "hv", "vh", "vv")


def band(name: str) -> Cx:
    return Cx(F.col(f"{name}_re"), F.col(f"{name}_im"))


def pauli(bands: DataFrame) -> DataFrame:
    """Magnitudes of HH - VV, HV + VH and HH + VV."""
    return bands.select(
        "r",
        "c",
        (band("hh") - band("vv")).abs().alias("red"),
        (band("hv") + band("vh")).abs().alias("green"),
        (band("hh") + band("vv")).abs().alias("blue"),
    )


def pauli_dual(bands: DataFrame, co: str = "hh", cross: str = "hv") -> DataFrame:
    """With two bands: co, cross, co."""
    return bands.select("r", "c", band(co).abs().alias("red"), band(cross).abs().alias("green"), band(co).abs().alias("blue"))


def coefficients(tx_angle: float, tx_ellipticity: float, rx_angle: float, rx_ellipticity: float) -> list[complex]:
    """Weights of HH, HV, VH and VV for transmit and receive polarisations, in degrees."""

    def jones(angle: float, ellipticity: float) -> tuple[complex, complex]:
        a, e = math.radians(angle), math.radians(ellipticity)
        return (
            complex(math.cos(a) * math.cos(e), -math.sin(a) * math.sin(e)),
            complex(math.sin(a) * math.cos(e), math.cos(a) * math.sin(e)),
        )

    th, tv = jones(tx_angle, tx_ellipticity)
    rh, rv = jones(rx_angle, rx_ellipticity)
    return [th * rh, th * rv, tv * rh, tv * rv]


def synthesised(bands: DataFrame, *angles: float) -> DataFrame:
    """The channel that the given polarisations would have seen."""
    total = Cx(F.lit(0.0), F.lit(0.0))
    for name, k in zip(NAMES, coefficients(*angles), strict=True):
        total = total + band(name) * Cx(F.lit(k.real), F.lit(k.imag))
    return bands.select("r", "c", total.re.alias("re"), total.im.alias("im"))


def smoothed(px: DataFrame, columns: list[str], half: int) -> DataFrame:
    """Running means; places outside the image count as the image's mean."""
    size = (2 * half + 1) ** 2
    sums = window_sums(px.withColumn("_n", F.lit(1.0)), [*columns, "_n"], half, half)
    means = px.agg(*[F.avg(x).alias(f"_{x}") for x in columns])  # one row
    out = [((F.col(x) + (size - F.col("_n")) * F.col(f"_{x}")) / size).alias(x) for x in columns]
    return sums.join(F.broadcast(means)).select("r", "c", *out)


def stokes(bands: DataFrame, half: int = 1, one: str = "hh", two: str = "hv") -> DataFrame:
    """Smoothed Stokes parameters with degree of polarisation and angles, in degrees."""
    a, b = band(one), band(two)
    x = a * b.conj()
    parts = bands.select("r", "c", (a.abs2() + b.abs2()).alias("s0"), (a.abs2() - b.abs2()).alias("s1"), (2 * x.re).alias("s2"), (-2 * x.im).alias("s3"))
    sums = smoothed(parts, ["s0", "s1", "s2", "s3"], half)
    s = {k: F.col(k) for k in ("s0", "s1", "s2", "s3")}
    polarised = F.sqrt(s["s1"] ** 2 + s["s2"] ** 2 + s["s3"] ** 2)
    return sums.select(
        "r",
        "c",
        *[v.alias(k) for k, v in s.items()],
        (polarised / s["s0"]).alias("degree"),
        F.degrees(F.atan2(s["s2"], s["s1"]) / 2).alias("psi"),
        F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["s3"] / polarised))) / 2).alias("chi"),
        F.degrees(F.atan2(s["s3"], s["s2"])).alias("delta"),
    )


def alpha_entropy(bands: DataFrame, half: int = 1) -> DataFrame:
    """Approximate alpha (degrees) and entropy from smoothed Pauli powers."""
    hh, hv, vh, vv = map(band, NAMES)
    n1, n2, n3 = hh + vv, hh - vv, hv - vh
    parts = bands.select("r", "c", n1.abs2().alias("p1"), n2.abs2().alias("p2"), n3.abs2().alias("p3"))
    sums = smoothed(parts, ["p1", "p2", "p3"], half)
    total = F.col("p1") + F.col("p2") + F.col("p3")
    q = [F.col(k) / total for k in ("p1", "p2", "p3")]
    return sums.select("r", "c", F.degrees(F.acos(F.sqrt(F.least(F.lit(1.0), q[0])))).alias("alpha"), (1.5 * (1 - (q[0] ** 2 + q[1] ** 2 + q[2] ** 2))).alias("entropy"))


def covariance(bands: DataFrame) -> DataFrame:
    """(a, b, re, im): sums of conj(a) b over all pixels, without removing means."""
    cells = []
    for one in NAMES:
        for two in NAMES:
            x = band(one).conj() * band(two)
            cells.append(F.struct(F.lit(one).alias("a"), F.lit(two).alias("b"), x.re.alias("re"), x.im.alias("im")))
    each = bands.select(F.explode(F.array(*cells)).alias("x"))
    return each.groupBy("x.a", "x.b").agg(F.sum("x.re").alias("re"), F.sum("x.im").alias("im"))


def saturated(value: Column, mean: Column, deviation: Column, k: float = 3.0) -> Column:
    top = mean + k * deviation
    return F.least(value, top) / top
