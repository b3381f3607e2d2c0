"""COSAR rasters: bursts of azimuth lines, each after two numbers that bound its valid samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Layout, RasterSource, read_bytes
from .patches import line_patches, write_patches

# The mark and its place, and the lines of annotation before a burst's samples.
MARK, MARK_AT, ANNOTATION = b"CSAR", 28, 4


def cosar_size(path: str) -> tuple[int, int]:
    """Range samples and azimuth lines of the first burst."""
    head = read_bytes(path, 0, 32)
    if head[MARK_AT : MARK_AT + 4] != MARK:
        raise ValueError(f"{path} is not COSAR")
    return struct.unpack(">2i", head[8:16])


class CosarSource(RasterSource):
    """Range runs down the rows, so stored lines are columns."""

    @classmethod
    def name(cls):
        return "cosar"

    def layout(self, path: str) -> Layout:
        samples, lines = cosar_size(path)
        return Layout(lines, samples, ">i2", True, ANNOTATION * 4 * (samples + 2), lead=8, turned=True)


def valid_places(spark: SparkSession, path: str, lines_at_once: int = 1024) -> DataFrame:
    """r, first, last: the valid columns of each row, counted from 0, where both bounds hold.

    A place is valid within the azimuth bounds of its range sample and the range bounds of
    its line.
    """
    samples, lines = cosar_size(path)
    width = 4 * (samples + 2)
    bounds = np.frombuffer(read_bytes(path, width, 3 * width), ">i4").reshape(3, -1)[:, 2:]
    by_row = spark.createDataFrame([(k, int(a) - 1, int(b) - 1) for k, (a, b) in enumerate(zip(bounds[1], bounds[2], strict=True))], "r long, low long, high long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                n = min(lines_at_once, lines - first)
                raw = np.frombuffer(read_bytes(path, (ANNOTATION + first) * width, n * width), np.uint8).reshape(n, width)[:, :8]
                marks = np.ascontiguousarray(raw).view(">i4").reshape(n, 2).astype(np.int64) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(marks[:, 0]), pa.array(marks[:, 1])], names=["c", "top", "bottom"])

    blocks = spark.range(0, lines, lines_at_once)
    columns = blocks.mapInArrow(read, "c long, top long, bottom long")
    both = columns.withColumn("r", F.explode(F.sequence("top", "bottom"))).join(F.broadcast(by_row), "r").where(F.col("c").between(F.col("low"), F.col("high")))
    return both.groupBy("r").agg(F.min("c").alias("first"), F.max("c").alias("last"))


def _head(samples: int, lines: int) -> bytes:
    """The lines of annotation; the azimuth bounds hold all lines."""
    width = samples + 2
    head = np.zeros((ANNOTATION, width), ">i4")
    head[0, :7] = [4 * width * (lines + ANNOTATION), 0, samples, lines, 1, 4 * width, lines + ANNOTATION]
    head[2, 2:], head[3, 2:] = 1, lines
    raw = head.tobytes()
    return raw[:MARK_AT] + MARK + raw[MARK_AT + 4 :]


def write_cosar(path: str, values: np.ndarray, first: np.ndarray | None = None) -> None:
    """A burst of complex numbers (range, azimuth), for tests and exchange; all of it valid unless first says otherwise.

    first: for each azimuth line its first valid range sample.
    """
    samples, lines = values.shape
    width = samples + 2
    body = np.zeros((lines, width, 2), ">i2")
    body[:, 2:, 0], body[:, 2:, 1] = np.round(values.real).T, np.round(values.imag).T
    marks = body[:, :2].reshape(lines, -1).copy().view(">i4")
    marks[:, 0], marks[:, 1] = 1 if first is None else first + 1, samples
    body[:, :2] = marks.view(">i2").reshape(lines, 2, 2)
    with open(path, "wb") as f:
        f.write(_head(samples, lines) + body.tobytes())


def write_pixels(px: DataFrame, path: str, samples: int, lines: int, first: Column | None = None) -> None:
    """As write_cosar, of r (range), c (azimuth), re and im, written in place by tasks.

    first: of an azimuth line ``c``, its first valid range sample. The two marks of a line
    stand in front of its samples as two pixels more, each of the halves of a number.
    """

    def mark(k: int, value: Column) -> Column:
        low = F.pmod(value.cast("long"), F.lit(1 << 16))
        signed = F.when(low >= 1 << 15, low - (1 << 16)).otherwise(low)
        return F.struct(F.lit(k).cast("long").alias("c"), F.floor(value / (1 << 16)).cast("double").alias("re"), signed.cast("double").alias("im"))

    bounds = F.array(mark(0, F.lit(1) if first is None else first + 1), mark(1, F.lit(samples)))
    marks = px.sparkSession.range(lines).select(F.col("id").alias("c")).select(F.col("c").alias("r"), F.inline(bounds))
    turned = px.where(F.col("r").between(0, samples - 1)).select(F.col("c").alias("r"), (F.col("r") + 2).alias("c"), "re", "im")
    head = _head(samples, lines)
    patches = line_patches(turned.unionByName(marks), lines, samples + 2, ">i2", len(head))
    write_patches(patches, path, len(head) + lines * 4 * (samples + 2), head)
