"""Products of bursts: a manifest that names files, annotations in XML, a frame for each burst.

A product is a relation of its parts. The manifest's files become rows, their annotations'
fields columns, and a burst a row with the polynomials that are nearest to its middle in
time. Pixels are joined to their burst by swath, polarisation and number. Steering and
centroid phases are expressions, so removing them is one projection; the polynomials of
the common model are fitted for all bursts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grouped
from ..operators.sensors import xml_fields
from . import blocks
from .tiff import tiff_layout

LIGHT = 299_792_458.0

# Kinds of files in a manifest, and paths of an annotation's fields.
PARTS = {"s1Level1MeasurementSchema": "data", "s1Level1ProductSchema": "product", "s1Level1CalibrationSchema": "calibration", "s1Level1NoiseSchema": "noise"}
IMAGE, GENERAL = "/product/imageAnnotation/imageInformation/", "/product/generalAnnotation/"
FIELDS = {
    "swath": ("/product/adsHeader/swath", "string"), "polarization": ("/product/adsHeader/polarisation", "string"),
    "lines_per_burst": ("/product/swathTiming/linesPerBurst", "int"), "samples": (IMAGE + "numberOfSamples", "int"), "lines": (IMAGE + "numberOfLines", "int"),
    "near_time": (IMAGE + "slantRangeTime", "double"), "line_time": (IMAGE + "azimuthTimeInterval", "double"), "line_spacing": (IMAGE + "azimuthPixelSpacing", "double"),
    "sampling_rate": (GENERAL + "productInformation/rangeSamplingRate", "double"), "frequency": (GENERAL + "productInformation/radarFrequency", "double"),
    "steering_rate": (GENERAL + "productInformation/azimuthSteeringRate", "double"),
}
LISTS = {
    "burst_times": "/product/swathTiming/burstList/burst/azimuthTime",
    "rate_times": GENERAL + "azimuthFmRateList/azimuthFmRate/azimuthTime", "rate_t0": GENERAL + "azimuthFmRateList/azimuthFmRate/t0", "rate_polys": GENERAL + "azimuthFmRateList/azimuthFmRate/azimuthFmRatePolynomial",
    "dc_times": "/product/dopplerCentroid/dcEstimateList/dcEstimate/azimuthTime", "dc_t0": "/product/dopplerCentroid/dcEstimateList/dcEstimate/t0", "dc_polys": "/product/dopplerCentroid/dcEstimateList/dcEstimate/dataDcPolynomial",
    "orbit_times": GENERAL + "orbitList/orbit/time", **{f"orbit_{a}": GENERAL + f"orbitList/orbit/position/{a}" for a in "xyz"},
}


def _texts(paths: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the text of the file that a column names, read where the row is."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: [blocks.read_bytes(p, 0, blocks.file_size(p)).decode("utf-8") for p in batch[column]]})

    return paths.mapInPandas(read, ", ".join(f"{n} {t}" for n, t in paths.dtypes) + f", {name} string")


def manifest_files(manifests: DataFrame) -> DataFrame:
    """A row for each measurement of the manifests at ``path``: folder, name, data, product, calibration, noise."""
    read = _texts(manifests.select("path"), "path", "xml")
    folder = F.regexp_replace("path", "[^/]*$", "")

    def hrefs(kind: str, part: str) -> Column:
        found = F.xpath("xml", F.lit(f"//dataObject[@repID='{kind}']/byteStream/fileLocation/@href"))
        return F.transform(found, lambda h: F.struct(F.lit(part).alias("part"), h.alias("href")))

    kinds = [hrefs(kind, part) for kind, part in PARTS.items()]
    each = read.select(folder.alias("folder"), F.explode(F.concat(*kinds)).alias("x")).select("folder", "x.part", F.regexp_replace("x.href", r"^\./", "").alias("href"))
    base = F.regexp_replace(F.regexp_extract("href", r"([^/]*)\.[^./]*$", 1), "^(calibration|noise)-", "")
    file = F.concat("folder", "href")
    return each.groupBy("folder", base.alias("name")).agg(*(F.max(F.when(F.col("part") == p, file)).alias(p) for p in PARTS.values())).where("data is not null")


def _seconds(text: Column) -> Column:
    return F.unix_micros(F.to_timestamp(text)) / 1e6


def _numbers(texts: Column) -> Column:
    return F.transform(texts, lambda x: x.cast("double"))


def _polynomials(texts: Column) -> Column:
    return F.transform(texts, lambda x: _numbers(F.split(F.trim(x), r"\s+")))


def annotations(files: DataFrame) -> DataFrame:
    """The measurements with what their product annotations say."""
    found = xml_fields(_texts(files, "product", "xml"), "xml", FIELDS)
    lists = {n: F.xpath(F.col("xml"), F.lit(p + "/text()")) for n, p in LISTS.items()}
    made = {}
    for n, values in lists.items():
        made[n] = F.transform(values, _seconds) if n.endswith("times") else _polynomials(values) if n.endswith("polys") else _numbers(values)
    return found.withColumns(made).drop("xml")


def _nearest(times: Column, moment: Column, *others: Column) -> list[Column]:
    at = F.array_min(F.transform(times, lambda t, k: F.struct(F.abs(t - moment).alias("d"), k.alias("k"))))["k"]
    return [F.get(x, at) for x in others]


def bursts(products: DataFrame, order: int = 5) -> DataFrame:
    """A row for each burst: its first line, times, polynomials and speed at its middle.

    The speed is that of polynomials through the state vectors of its product.
    """
    each = products.select("*", F.posexplode("burst_times").alias("burst", "start")).withColumn("first_line", F.col("burst") * F.col("lines_per_burst"))
    centre = F.expr("lines_per_burst div 2")
    each = each.withColumn("centre", centre).withColumn("middle", centre * F.col("line_time"))
    moment = F.col("start") + F.col("middle")
    rate_t0, rate = _nearest(F.col("rate_times"), moment, F.col("rate_t0"), F.col("rate_polys"))
    dc_t0, dc = _nearest(F.col("dc_times"), moment, F.col("dc_t0"), F.col("dc_polys"))
    each = each.withColumns({"rate_zero": rate_t0, "rate": rate, "dc_zero": dc_t0, "dc": dc})
    key = ["folder", "name", "burst"]
    vectors = F.arrays_zip(F.col("orbit_times").alias("t"), *(F.col(f"orbit_{a}").alias(a) for a in "xyz"))
    states = each.select(*key, "start", F.inline(vectors)).withColumn("s", F.col("t") - F.col("start"))
    fits = grouped.polynomials(states, key, "s", ["x", "y", "z"], order)
    names = ["rate_zero", "rate", "dc_zero", "dc"]
    kept = each.select(*key, "data", "swath", "polarization", "first_line", "lines_per_burst", "samples", "near_time", "line_time", "line_spacing", "sampling_rate", "frequency", "steering_rate", "start", "centre", "middle", *names)
    slope = lambda p: F.aggregate(F.transform(F.col(p), lambda c, k: c * k * F.pow(F.col("middle"), F.greatest(k - 1, F.lit(0)).cast("double"))), F.lit(0.0), lambda a, b: a + b)
    speed = F.sqrt(reduce(lambda a, b: a + b, (slope(f"{a}_poly") * slope(f"{a}_poly") for a in "xyz")))
    return kept.join(fits, key).withColumn("speed", speed)


def _horner(poly: Column, x: Column) -> Column:
    return F.aggregate(F.reverse(poly), F.lit(0.0), lambda a, c: a * x + c)


def phase(line: Column, sample: Column) -> tuple[Column, Column, Column]:
    """Turns that steering and centroid add at a line and sample of a burst; the centroid; the rate.

    Columns of ``bursts`` have to be there. Lines count from the burst's first one.
    """
    near = F.col("near_time")
    tau = near + sample / F.col("sampling_rate")
    rate = lambda t: _horner(F.col("rate"), t - F.col("rate_zero"))
    centroid = lambda t: _horner(F.col("dc"), t - F.col("dc_zero"))
    steered = 2 * F.col("speed") / LIGHT * F.col("frequency") * F.radians("steering_rate")
    a, f = rate(tau), centroid(tau)
    total = a * steered / (a - steered)
    reference = -f / a + centroid(near) / rate(near)
    since = (line - F.col("centre")) * F.col("line_time") - reference
    return total * since * since / 2 + f * since, f, a


def deramped(px: DataFrame, found: DataFrame) -> DataFrame:
    """Pixels of bursts without the phase of steering and centroid.

    px: folder, name, r, c, re, im; r counts the measurement's lines. Adds burst and line.
    """
    facts = ["near_time", "sampling_rate", "rate", "rate_zero", "dc", "dc_zero", "speed", "frequency", "steering_rate", "centre", "line_time"]
    sizes = found.groupBy("folder", "name").agg(F.max("lines_per_burst").alias("per_burst"))
    numbered = px.join(sizes, ["folder", "name"]).withColumn("burst", F.expr("cast(r div per_burst as int)")).withColumn("line", F.col("r") % F.col("per_burst"))
    turns = phase(F.col("line"), F.col("c"))[0]
    both = numbered.join(found.select("folder", "name", "burst", *facts), ["folder", "name", "burst"]).withColumn("_a", -2 * F.lit(3.141592653589793) * turns)
    cos, sin = F.cos("_a"), F.sin("_a")
    return both.select("folder", "name", "burst", "line", "c", (F.col("re") * cos - F.col("im") * sin).alias("re"), (F.col("re") * sin + F.col("im") * cos).alias("im"))


def phase_polynomials(found: DataFrame) -> DataFrame:
    """Bursts with phase_poly and delta_kcoa_poly over metres from the middle, [range][azimuth].

    The phase is sampled at three lines and three samples of each burst.
    """
    spots = lambda n: F.array(F.lit(0), F.round((n - 1) / 2.0), n - 1)
    rg = LIGHT / 2 / F.col("sampling_rate")
    centre = F.expr("samples div 2")
    grid = F.flatten(F.transform(spots(F.col("lines_per_burst")), lambda line: F.transform(spots(F.col("samples")), lambda s: F.struct(line.cast("double").alias("line"), s.cast("double").alias("s")))))
    sampled = found.withColumn("_grid", grid).select(
        "*",
        F.transform("_grid", lambda g: (g["line"] - F.col("centre")) * F.col("line_spacing")).alias("_az"),
        F.transform("_grid", lambda g: (g["s"] - centre) * rg).alias("_rg"),
        F.transform("_grid", lambda g: phase(g["line"], g["s"])[0]).alias("phase"),
    )
    fitted = grouped.surfaces(sampled.drop("_grid"), "_rg", "_az", ["phase"], (2, 2)).drop("_az", "_rg", "phase")
    # What the phase rises by along azimuth.
    rise = F.transform("phase_poly", lambda p: F.transform(F.slice(p, 2, F.size(p) - 1), lambda c, k: c * (k + 1)))
    return fitted.withColumn("delta_kcoa_poly", rise)


def measurements(spark: SparkSession, files: DataFrame) -> DataFrame:
    """folder, name, r, c, re, im of all measurements, each read in parts by tasks.

    The list of files reaches the driver once, as what to read has to be planned.
    """
    out = None
    for row in files.select("folder", "name", "data").collect():
        tiff_layout(row["data"])
        px = spark.read.format("tiffraster").load(row["data"]).select(F.lit(row["folder"]).alias("folder"), F.lit(row["name"]).alias("name"), "r", "c", "re", "im")
        out = px if out is None else out.unionByName(px)
    return out
