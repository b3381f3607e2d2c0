"""Files written in place by tasks, each at its own offsets.

The driver makes an empty file of the whole size; tasks put their bytes where they belong.
A task that runs again writes the same bytes to the same places. The folder must be one
that driver and executors share and that allows writing within a file.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; local sessions may have none set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="echofield-files-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_file(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, without its scheme."""
    root = scratch(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"files can't be written in place in {root}")
    return f"{root.removeprefix('file://').removeprefix('file:')}/{uuid.uuid4().hex}-{name}"


class PatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with open(self.path, "r+b") as f:
            for batch in iterator:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    f.seek(at)
                    f.write(data.as_buffer())
        return WriterCommitMessage()


class PatchSink(DataSource):
    """Rows (at, data) go to the file at ``path``."""

    @classmethod
    def name(cls):
        return "patches"

    def schema(self):
        return "at long, data binary"

    def writer(self, schema, overwrite):
        return PatchWriter(self.options["path"])


def write_patches(patches: DataFrame, path: str, size: int, head: bytes = b"", fixed: list[tuple[int, bytes]] | None = None) -> None:
    """patches: at, data. ``head`` and ``fixed`` are small parts that the driver knows."""
    with open(path, "wb") as f:
        f.write(head)
        for at, data in fixed or []:
            f.seek(at)
            f.write(data)
        f.truncate(size)
    spark = patches.sparkSession
    spark.dataSource.register(PatchSink)
    patches.select("at", "data").write.format("patches").mode("append").save(path)


#: Bytes of a strip of lines that a task packs at once.
STRIP = 1 << 16


def strip_lines(width: int, rows: int) -> int:
    """Lines of ``width`` bytes in a strip."""
    return max(1, min(rows, STRIP // max(1, width)))


def block_patches(
    px: DataFrame,
    rows: int,
    cols: int,
    block: tuple[int, int],
    element: str,
    at: Column,
    planes: list[str] | None = None,
    plane_axis: int = -1,
    convert: Callable | None = None,
    stored: Callable[[int], int] | None = None,
) -> DataFrame:
    """A row for each block of px, packed: at, data.

    ``at`` is the place of a block by its grid numbers i and j. ``planes`` are columns of
    numbers; plane_axis is -1 for samples that stand together, 1 for lines of planes, 0 for
    planes one behind the other; ``convert`` makes what is stored of the numbers. ``stored``
    says how many lines of the blocks i are, if not all. Missing pixels are zeros. A block is one group.
    """
    names = planes or ["re", "im"]
    lines, samples = block

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((lines, samples, len(names)))
        out[part["r"].to_numpy() % lines, part["c"].to_numpy() % samples] = part[names].to_numpy()
        out = out[: stored(int(key[0]))] if stored else out
        kind = np.dtype(element)
        out = convert(out) if convert else out if kind.kind == "f" else np.round(out)
        out = np.moveaxis(out, 2, plane_axis if plane_axis >= 0 else 2)
        return pd.DataFrame({"at": [key[2]], "data": [np.ascontiguousarray(out.astype(kind)).tobytes()]})

    inside = px.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    placed = inside.withColumn("i", F.floor(F.col("r") / lines)).withColumn("j", F.floor(F.col("c") / samples)).withColumn("at", at.cast("long"))
    return placed.select("i", "j", "at", "r", "c", *dict.fromkeys(names)).groupBy("i", "j", "at").applyInPandas(pack, "at long, data binary")


def line_patches(px: DataFrame, rows: int, cols: int, element: str, begin: int, planes: list[str] | None = None, plane_axis: int = -1, convert: Callable | None = None) -> DataFrame:
    """As block_patches for an image that isn't in blocks: strips of whole lines from ``begin`` on, nothing behind the last line."""
    width = len(planes or ["re", "im"]) * np.dtype(element).itemsize * cols
    lines = strip_lines(width, rows)
    return block_patches(px, rows, cols, (lines, cols), element, begin + F.col("i") * lines * width, planes, plane_axis, convert, lambda i: min(lines, rows - i * lines))
