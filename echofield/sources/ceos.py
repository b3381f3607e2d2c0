"""CEOS files: chains of records, each of which says how long it is.

Where records begin can be known only by following the chain from the start. A large file
is followed from many places at once: a task guesses the first record of its range by trying
every byte, takes what begins a run of records with ascending numbers, and follows the chain
to the end of the range. Then the ranges' ends are held against the next ones' beginnings;
all ranges that were wrong are followed again from where they truly begin. A file may be
kept in compressed strips.

Images of one record per line are read as tiles; their lines' prefixes and the leaders'
fields become tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from . import blocks, strips
from .patches import scratch_file
from .tiles import SCHEMA, Image, Place, TileReader

#: Bytes of a range.
RANGE = 64 << 20
#: Records that have to follow a guess, and the most bytes of one.
FOLLOWING, LONGEST = 3, 1 << 24
HEAD = 12
#: Bytes that are read at once behind records shorter than SHORT.
WINDOW, SHORT = 1 << 18, 1 << 14
HEADS = np.dtype([("number", ">u4"), ("subtype", "u1"), ("type", "u1"), ("subtype2", "u1"), ("subtype3", "u1"), ("length", ">u4")])

# Types of records, and places and widths of fields of the file descriptor.
SUMMARY, POSITION, ATTITUDE, RADIOMETRIC, QUALITY, FACILITY = 10, 30, 40, 50, 60, 200
DESCRIPTOR = {"bits": (216, 4), "group_bytes": (224, 4), "lines": (236, 8), "left": (244, 4), "pixels": (248, 8), "prefix": (276, 4), "line_bytes": (280, 8), "suffix": (288, 4)}
KIND_AT = (428, 4)
# Fields of a line's prefix.
PREFIX = [
    ("record", 0, ">u4"), ("line", 12, ">u4"), ("left_fill", 20, ">u4"), ("pixels", 24, ">u4"), ("year", 36, ">u4"), ("day", 40, ">u4"), ("msec", 44, ">u4"),
    ("tx_pol", 52, ">u2"), ("rcv_pol", 54, ">u2"), ("prf", 56, ">u4"), ("usec", 84, ">u8"), ("slant_range", 116, ">u4"), ("lat_center", 196, ">i4"), ("lon_center", 208, ">i4"),
]
PREFIX_BYTES = 412
# Fields of the leader's records, by type of record.
FIELDS = {
    SUMMARY: {
        "scene_id": (20, 32), "ctr_line": (324, 8), "ctr_pixel": (332, 8), "clock_angle": (476, 8), "wavelength": (500, 16), "pulse_code": (518, 16),
        "sampling_rate": (710, 16), "pulse_width": (742, 16), "prf": (934, 16), "bw_az": (1238, 16), "bw_rng": (1254, 16),
        "at_dop_const": (1414, 16), "at_dop_lin": (1430, 16), "at_dop_quad": (1446, 16), "xt_dop_const": (1478, 16), "xt_dop_lin": (1494, 16), "xt_dop_quad": (1510, 16),
        "xt_rate_const": (1606, 16), "xt_rate_lin": (1622, 16), "xt_rate_quad": (1638, 16), "line_spacing": (1686, 16), "pixel_spacing": (1702, 16),
    },
    POSITION: {"points": (140, 4), "year": (144, 4), "month": (148, 4), "day": (152, 4), "day_in_year": (156, 4), "second": (160, 22), "interval": (182, 22)},
    RADIOMETRIC: {"cal_factor": (20, 16)},
    QUALITY: {"slant_resolution": (126, 16), "azimuth_resolution": (142, 16)},
}
TEXTS = ("scene_id", "pulse_code")
POINTS_AT, POINT_WIDTH = 386, 22
POINT = ("x", "y", "z", "vx", "vy", "vz")

RECORDS = "range long, at long, number long, subtype int, type int, subtype2 int, subtype3 int, length long"


class Chain:
    """Records of a file from a place on. The file is opened once; short records are read many at a time."""

    def __init__(self, path: str):
        self.path, self.file = path, strips.opened(path)
        self.size, self.begin, self.raw, self.last = self.file.size(), 0, b"", 0

    def __enter__(self) -> Chain:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def bytes(self, at: int, n: int) -> bytes:
        if not self.begin <= at <= at + n <= self.begin + len(self.raw):
            self.begin, self.raw = at, self.file.read_at(max(n, WINDOW if self.last < SHORT else 0), at)
        return self.raw[at - self.begin : at - self.begin + n]

    def head(self, at: int) -> bytes | None:
        """The head of the record at a place; none if there can't be one."""
        if at + HEAD > self.size:
            return None
        found = self.bytes(at, HEAD)
        n = length(found)
        return found if HEAD <= n <= LONGEST and at + n <= self.size else None

    def holds(self, at: int) -> bool:
        """Whether records with ascending numbers follow."""
        last = None
        for _ in range(FOLLOWING + 1):
            if at == self.size and last is not None:
                return True
            found = self.head(at)
            number = int.from_bytes(found[:4], "big") if found else None
            if found is None or last is not None and number != last + 1:
                return False
            last, at = number, at + length(found)
        return True

    def guess(self, start: int, end: int) -> int:
        """The first place from start on where a record can begin; end if none does."""
        if start == 0:
            return 0
        step = 1 << 12
        while start < end:
            raw = np.frombuffer(self.bytes(start, min(step + HEAD, self.size - start)), np.uint8).astype(np.int64)
            n = min(len(raw) - HEAD + 1, end - start)
            if n <= 0:
                break
            lengths = raw[8 : 8 + n] << 24 | raw[9 : 9 + n] << 16 | raw[10 : 10 + n] << 8 | raw[11 : 11 + n]
            fits = (lengths >= HEAD) & (lengths <= LONGEST) & (start + np.arange(n) + lengths <= self.size)
            for at in np.flatnonzero(fits).tolist():
                if self.holds(start + at):
                    return start + at
            start, step = start + n, min(2 * step, 1 << 20)
        return end

    def follow(self, at: int, end: int) -> pd.DataFrame:
        """at, number, codes and length of the records that begin before end."""
        places, heads = [], []
        while at < min(end, self.size):
            found = self.head(at)
            if found is None:
                raise ValueError(f"{self.path} has no record at {at}")
            places.append(at)
            heads.append(found)
            self.last = length(found)
            at += self.last
        found = np.frombuffer(b"".join(heads), HEADS)
        return pd.DataFrame({"at": np.array(places, np.int64), **{n: found[n].astype(np.int64) for n in HEADS.names}})


def length(head: bytes) -> int:
    return int.from_bytes(head[8:12], "big")


def wrong_ranges(ends: dict[int, tuple[int, int]], n: int, range_bytes: int, size: int) -> dict[int, int]:
    """Ranges that don't begin where the range before ends, with where they should.

    Where a wrong range ends isn't known, so the next one is taken to be right; if it isn't,
    that shows when the wrong one has been followed again.
    """
    after, known, wrong = 0, True, {}
    for k in range(n):
        first, last = ends.get(k, (None, None))
        if known and (first != after if after < min((k + 1) * range_bytes, size) else first is not None):
            wrong[k], known = after, False
        elif first is not None:
            after, known = last, True
    return wrong


def records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """range, at, number, codes and length of every record of a file."""
    with strips.opened(path) as f:
        size = f.size()
    n = -(-size // range_bytes)

    def walk(starts: dict[int, int]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with Chain(path) as chain:
                for batch in batches:
                    for k in batch["range"].tolist():
                        end = min((k + 1) * range_bytes, size)
                        at = starts[k] if k in starts else chain.guess(k * range_bytes, end)
                        found = chain.follow(at, end)
                        found.insert(0, "range", k)
                        yield found

        return run

    # Small ranges share a task, as each task costs more than following one.
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // RANGE))
    ranges = spark.range(n, numPartitions=max(1, min(n, tasks, 4096))).withColumnRenamed("id", "range")
    folder = "file://" + scratch_file(spark, "records")
    ranges.mapInPandas(walk({}), RECORDS).write.parquet(f"{folder}/0")
    kept, true, rounds = spark.read.parquet(f"{folder}/0"), {}, 0
    while True:
        # One row for each range.
        ends = {r["range"]: (r["first"], r["after"]) for r in kept.groupBy("range").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("length")).alias("after")).collect()}
        wrong = wrong_ranges(ends, n, range_bytes, size)
        if not wrong:
            return kept
        if true.get(min(wrong)) == wrong[min(wrong)]:
            raise ValueError(f"{path} isn't a chain of records")
        true |= wrong
        rounds += 1
        # Of what was followed before, only wrong ranges are followed again and written.
        ranges.where(F.col("range").isin(list(wrong))).mapInPandas(walk(wrong), RECORDS).write.parquet(f"{folder}/{rounds}")
        kept = kept.where(~F.col("range").isin(list(wrong))).unionByName(spark.read.parquet(f"{folder}/{rounds}"))


def contents(found: DataFrame, path: str) -> DataFrame:
    """Records with their bytes, read by the tasks that hold the rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with strips.opened(path) as f:
            for batch in batches:
                yield batch.assign(content=[f.read_at(n, a) for a, n in zip(batch["at"].tolist(), batch["length"].tolist(), strict=True)])

    return found.mapInPandas(read, RECORDS + ", content binary")


def fields(content: Column, kind: int) -> list[Column]:
    """Columns of the texts and numbers of a record."""
    out = []
    for name, (at, n) in FIELDS[kind].items():
        piece = F.trim(F.decode(F.substring(content, at + 1, n), "ISO-8859-1"))
        out.append((piece if name in TEXTS else piece.try_cast("double")).alias(name))
    return out


def points(content: Column, count: Column) -> Column:
    """The state vectors of a position record: an array of structs."""
    text = F.decode(content, "ISO-8859-1")

    def value(k: Column, j: int) -> Column:
        return F.trim(F.substring(text, (k * len(POINT) + j) * POINT_WIDTH + POINTS_AT + 1, F.lit(POINT_WIDTH))).try_cast("double")

    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: F.struct(k.alias("k"), *(value(k, j).alias(n) for j, n in enumerate(POINT))))


def descriptor(path: str) -> dict:
    head = blocks.read_bytes(path, 0, 720)
    out = {name: int(head[at : at + n].strip() or 0) for name, (at, n) in DESCRIPTOR.items()}
    return out | {"length": int.from_bytes(head[8:12], "big"), "kind": head[KIND_AT[0] : sum(KIND_AT)].decode("latin-1").strip()}


class CeosReader(TileReader):
    def __init__(self, path: str, options: dict):
        d = descriptor(path)
        complex_ = d["kind"].startswith("C*8")
        self.item = 8 if complex_ else 2
        self.first = d["length"] + d["prefix"]
        self.line = d["prefix"] + d["pixels"] * self.item + d["suffix"]
        turn = (options.get("left", "false").lower() == "true", False, True) if options.get("oriented", "true").lower() == "true" else (False,) * 3
        step = max(1, min(d["lines"], blocks.BLOCK // self.line))
        super().__init__(path, [Image(0, d["lines"], d["pixels"], step, d["pixels"], ">f4" if complex_ else ">u2", ("iq",) if complex_ else ("real",), 1, turn)], options)

    def place(self, image: Image, i: int, j: int) -> Place:
        at = self.first + i * image.tile_lines * self.line
        return Place((at, at + 4) if self.item == 8 else (at,), self.line, self.item)


class CeosSource(DataSource):
    """An image of a record for each line. ``left`` says that the sensor looked to the left."""

    @classmethod
    def name(cls):
        return "ceosimage"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CeosReader(self.options["path"], self.options)


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CeosSource)


def line_table(spark: SparkSession, path: str, lines_per_task: int = 1 << 14) -> DataFrame:
    """The prefixes of an image's lines; pixels aren't read."""
    d = descriptor(path)
    width = d["prefix"] + d["pixels"] * (8 if d["kind"].startswith("C*8") else 2) + d["suffix"]
    kind = np.dtype({"names": [n for n, _, _ in PREFIX], "offsets": [a for _, a, _ in PREFIX], "formats": [t for _, _, t in PREFIX], "itemsize": PREFIX_BYTES})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = b"".join(blocks.read_bytes(path, d["length"] + k * width, PREFIX_BYTES) for k in batch["id"].tolist())
            found = np.frombuffer(raw, kind)
            yield pd.DataFrame({n: found[n].astype(np.int64) for n in kind.names})

    n = d["lines"]
    return spark.range(n, numPartitions=max(1, -(-n // lines_per_task))).mapInPandas(read, ", ".join(f"{n} long" for n, _, _ in PREFIX))


def product_fields(leaders: DataFrame) -> DataFrame:
    """Grid, timing and calibration that follow from the summary's columns."""
    light = 299_792_458.0
    left = F.col("clock_angle") < 0
    dt = F.when(left, -1.0).otherwise(1.0) * 1000 / F.col("prf")
    row = F.col("ctr_pixel")
    rate = F.col("xt_rate_const") + row * (F.col("xt_rate_lin") + row * F.col("xt_rate_quad"))
    centroid = (
        F.col("xt_dop_const") + row * (F.col("xt_dop_lin") + row * F.col("xt_dop_quad"))
        + F.col("at_dop_const") + F.col("ctr_line") * (F.col("at_dop_lin") + F.col("ctr_line") * F.col("at_dop_quad"))
        - (F.col("at_dop_const") + F.col("xt_dop_const")) / 2
    )
    return leaders.select(
        "*",
        left.alias("left"),
        (2 / F.col("wavelength")).alias("row_kctr"),
        (light / F.col("wavelength")).alias("freq_zero"),
        (2 * F.col("bw_rng") * 1000 / light).alias("row_bw"),
        (F.col("bw_az") * 1000 / F.col("prf") / F.col("line_spacing")).alias("col_bw"),
        (dt / F.col("line_spacing")).alias("time_ca_1"),
        centroid.alias("doppler_scp"),
        rate.alias("doppler_rate_scp"),
        (centroid * dt / F.col("line_spacing")).alias("delta_kcoa"),
    )
