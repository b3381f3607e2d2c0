"""File formats told by their first bytes."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hdf5, sicd
from .blocks import read_bytes
from .cosar import MARK, MARK_AT
from .sio import MAGIC, MAGIC_USER

#: Bytes of a file's beginning that are looked at; formats with a structure are followed from there.
HEAD = 4096

# What the beginning of a product's description says.
DESCRIPTIONS = [("sentinel1", ("SENTINEL-1", "SLC")), ("tsx", ("level1Product", "TSX|TDX|PAZ")), ("rs", ("RADARSAT-2|RCM",))]
BEGINNINGS = [(b"GSATIMG", "gff"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"CPHD/", "cphd"), (b"CRSD/", "crsd"), (b"BegPreamble", "cphd30")]


def format_of(path: str) -> str | None:
    """A file's format by its first bytes and, where these name a container, by its headers; null if unknown."""
    head = read_bytes(path, 0, HEAD)
    numbers = {struct.unpack(order + "I", head[:4])[0] for order in "<>"} if len(head) >= 4 else set()
    if head[:9] in (b"NITF02.10", b"NITF02.00", b"NSIF01.00"):
        try:
            return "sicd" if sicd.read_image(path) else None
        except ValueError:  # no description among the extensions, or headers that can't be followed
            return "sicd" if b"<SICD" in head else "nitf"
    if head[:8] == hdf5.SIGNATURE:
        return hdf5.File(path).product
    if head[MARK_AT : MARK_AT + 4] == MARK:
        return "cosar"
    if numbers & {MAGIC, MAGIC_USER}:
        return "sio"
    for start, name in BEGINNINGS:
        if head.startswith(start):
            return name
    text = head.decode("latin-1").removeprefix("\xef\xbb\xbf").lstrip()
    if text.startswith("<"):
        return next((name for name, marks in DESCRIPTIONS if all(re.search(m, text) for m in marks)), None)
    return "mbw" if re.match("type\\s*=", text, re.IGNORECASE) else None


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """path, format (null if unknown) of the files below a folder. Only headers are read, in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(format=[format_of(p) for p in batch["path"]])

    return files.mapInPandas(read, "path string, format string")


# Fixed-width headers

# Fields of the file header's beginning, with their widths.
NITF_HEADER = [
    ("profile", 9), ("complexity", 2), ("standard", 4), ("station", 10), ("date", 14), ("title", 80), ("classification", 1),
    ("security", 166), ("copy", 5), ("copies", 5), ("encryption", 1), ("background", 3), ("originator", 24), ("phone", 18),
    ("file_length", 12), ("header_length", 6), ("images", 3),
]

# Fields of some extensions, with their widths; numbers are marked.
EXTENSIONS = {
    "BLOCKA": [("block", 2, True), ("n_gray", 5, True), ("lines", 5, True), ("layover", 3, True), ("shadow", 3, True), ("reserved", 16, False), ("frlc", 21, False), ("lrlc", 21, False), ("lrfc", 21, False), ("frfc", 21, False)],
    "AIMIDA": [("date_time", 12, False), ("mission", 4, True), ("sortie", 10, False), ("operation", 2, False), ("segment", 2, False)],
}


def fixed_width(raw: Column, fields: list[tuple]) -> list[Column]:
    """Columns of consecutive fields of a text; a third item marks numbers."""
    out, at = [], 1
    for name, width, *number in fields:
        piece = F.trim(F.substring(raw, at, width))
        out.append((piece.try_cast("double") if number and number[0] else piece).alias(name))
        at += width
    return out


def nitf_headers(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode(F.expr("substring(content, 1, 400)"), "ISO-8859-1").alias("head")).select("path", *fixed_width(F.col("head"), NITF_HEADER))


def extension(raw: Column, tag: str) -> list[Column]:
    return fixed_width(raw, EXTENSIONS[tag])


def written_field(value: Column, width: int, number: bool = False) -> Column:
    """Numbers are padded with zeros on the left, text with spaces on the right."""
    return F.lpad(value.cast("string"), width, "0") if number else F.rpad(value.cast("string"), width, " ")


def registered(spark: SparkSession) -> None:
    """Make the raster formats known to spark.read.format, with bounds pushed down."""
    from . import opened

    opened.registered(spark)
