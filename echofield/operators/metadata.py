"""Metadata that follows from other metadata, and rules that it must keep.

Fields are filled only where they are missing. Rules become findings: one projection
makes them all, and one explode turns them into rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Each field where it is missing, in order: later ones may use earlier ones."""
    for name, value in fields.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def waveform(df: DataFrame) -> DataFrame:
    """Of bandwidth, pulse length and chirp rate any two give the third; then frequencies."""
    return filled(
        df,
        {
            "bandwidth": F.col("length") * F.col("rate"),
            "length": F.col("bandwidth") / F.col("rate"),
            "rate": F.col("bandwidth") / F.col("length"),
            "tx_min": F.col("start_frequency") + F.least(F.lit(0.0), F.signum("rate") * F.col("bandwidth")),
            "tx_max": F.col("start_frequency") + F.greatest(F.lit(0.0), F.signum("rate") * F.col("bandwidth")),
        },
    )


def radiometric(df: DataFrame) -> DataFrame:
    """beta0, rcs, sigma0 and gamma0 scale factors from whichever is there.

    Needs pixel_area, slope and graze in degrees.
    """
    slope, graze = F.cos(F.radians("slope")), F.sin(F.radians("graze"))
    beta = F.coalesce(F.col("beta0"), F.col("rcs") / F.col("pixel_area"), F.col("sigma0") / slope, F.col("gamma0") * graze / slope)
    df = df.withColumn("beta0", beta)
    return filled(df, {"rcs": F.col("beta0") * F.col("pixel_area"), "sigma0": F.col("beta0") * slope, "gamma0": F.col("beta0") * slope / graze})


def resolution(df: DataFrame, broadening: float = 0.886) -> DataFrame:
    """Impulse response width and bandwidth, from each other."""
    return filled(df, {"width": broadening / F.col("response_bandwidth"), "response_bandwidth": broadening / F.col("width")})


def shifted_frequencies(df: DataFrame, offset: Column, names: list[str]) -> DataFrame:
    """Adds a reference frequency to all frequencies."""
    return df.withColumns({x: F.col(x) + offset for x in names})


def version_at_least(version: Column, wanted: str) -> Column:
    """Dotted versions, compared number by number; missing numbers are zeros."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    width = 4
    own = F.concat(parts, F.array_repeat(F.lit(0), width - F.size(parts)))
    least = [int(x) for x in wanted.split(".")]
    least += [0] * (width - len(least))
    return own >= F.array(*map(F.lit, least))


# Image quality

# Slope and offset of the rating over log2 of bits per square metre.
RATING_SLOPE, RATING_OFFSET = 0.4357, 3.4761


def information(bandwidth_area: Column, snr: Column) -> Column:
    """Bits per square metre."""
    return bandwidth_area * F.log2(1 + snr)


def rating(bits: Column) -> Column:
    """Logarithmic, and below the transition the tangent through the origin."""
    transition = math.exp(1 - RATING_OFFSET * math.log(2) / RATING_SLOPE)
    tangent = RATING_SLOPE / (math.log(2) * transition)
    return F.when(bits < transition, bits * tangent).otherwise(RATING_SLOPE * F.log2(bits) + RATING_OFFSET)


def assumed_signal(polarisation: Column) -> Column:
    """1 for equal transmit and receive polarisations, else a quarter."""
    tx, rx = F.substring_index(polarisation, ":", 1), F.substring_index(polarisation, ":", -1)
    return F.when(tx == rx, 1.0).otherwise(0.25)


def quality(bandwidth: Column, noise_db: Column, graze: Column, signal: Column | float = 1.0) -> tuple[Column, Column]:
    """Bits per square metre and rating of a system with equal bandwidths on the ground."""
    light = 299792458.0
    area = F.pow(2 * bandwidth / light * F.cos(F.radians(graze)), F.lit(2.0))
    bits = information(area, signal / F.pow(10.0, noise_db / 10))
    return bits, rating(bits)


def measure_scale(kind: str, area: Column, slope: Column, graze: Column, pixels: Column | float = 1.0, oversample: Column | float = 1.0) -> Column:
    """The factor from total cross section to a measure."""
    s, g = F.cos(F.radians(slope)), F.sin(F.radians(graze))
    return {"rcs": F.lit(1.0), "sigma0": s / area, "beta0": 1 / area, "gamma0": s / (g * area), "power": oversample / pixels * F.lit(1.0)}[kind]


def predicted_noise(noise_db: Column, factor: Column) -> Column:
    return F.pow(10.0, noise_db / 10) * factor


# Rules


@dataclass(frozen=True)
class Rule:
    """A finding where ``broken`` holds; unknown is not broken."""

    name: str
    level: str
    broken: Column
    message: str


def findings(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(key, rule, level, message): a row per broken rule."""
    each = F.array(*[F.when(F.coalesce(x.broken, F.lit(False)), F.struct(F.lit(x.name).alias("rule"), F.lit(x.level).alias("level"), F.lit(x.message).alias("message"))) for x in rules])
    return df.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select(key, "f.rule", "f.level", "f.message")


def collect_rules() -> list[Rule]:
    """Rules for catalog rows."""
    c = F.col
    return [
        Rule("latitude", "Error", F.abs(c("lat")) > 90, "latitude is beyond 90 degrees"),
        Rule("longitude", "Error", F.abs(c("lon")) > 180, "longitude is beyond 180 degrees"),
        Rule("graze", "Error", ~c("graze").between(0, 90), "grazing angle is not within 0 to 90 degrees"),
        Rule("graze_low", "Info", c("graze") < 25, "grazing angle is very low"),
        Rule("azimuth", "Error", (c("azim") < 0) | (c("azim") >= 360), "azimuth is not within 0 to 360 degrees"),
        Rule("height", "Warning", ~c("hae").between(-500, 9000), "height is not on the earth's surface"),
        Rule("side", "Error", ~c("side").isin("L", "R"), "side of track is neither L nor R"),
        Rule("polarisation", "Error", ~c("pol").rlike("^[HV]:[HV]$"), "polarisation is not known"),
        Rule("cross_polar", "Info", c("pol").isin("H:V", "V:H"), "only a cross-polarised channel"),
        Rule("side_azimuth", "Warning", (c("side") == "L") & (c("azim") > 350), "left look from due north"),
    ]
