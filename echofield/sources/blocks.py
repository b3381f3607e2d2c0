"""Binary rasters read by ranges of bytes, so that a large file is many partitions.

Files are opened through pyarrow's filesystems: a path may be local or a URI.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a partition, and pixels that its task holds at once.
BLOCK, PIXELS = 32 << 20, 1 << 18

# Names of stored element types.
ELEMENTS = {
    "uint8": "u1", "uchar": "u1", "int8": "i1", "schar": "i1", "uint16": "u2", "int16": "i2", "uint32": "u4",
    "int32": "i4", "uint64": "u8", "int64": "i8", "float32": "f4", "float64": "f8", "double": "f8",
}


def opened(path: str):
    filesystem, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return filesystem.open_input_file(inner)


def read_bytes(path: str, offset: int, length: int) -> bytes:
    with opened(path) as f:
        return f.read_at(length, offset)


def pieces(first: int, last: int, samples: int) -> list[tuple[int, int]]:
    """Lines first to last as runs of few pixels."""
    step = max(1, PIXELS // max(1, samples))
    return [(k, min(k + step - 1, last)) for k in range(first, last + 1, step)]


@dataclass(frozen=True)
class Layout:
    """A raster of interleaved samples."""

    rows: int
    cols: int
    element: str  # numpy type with its byte order
    complex: bool
    offset: int
    lead: int = 0  # bytes before each row's samples
    turned: bool = False  # stored rows are the image's columns

    @property
    def row_bytes(self) -> int:
        return self.lead + self.cols * (2 if self.complex else 1) * np.dtype(self.element).itemsize


def pixel_batch(raw: bytes, layout: Layout, first: int, keep_rows: np.ndarray, cols: np.ndarray) -> pa.RecordBatch:
    """Pixels of consecutive rows; keep_rows are row numbers in the image."""
    lines = np.frombuffer(raw, np.uint8).reshape(-1, layout.row_bytes)[:, layout.lead :]
    values = np.ascontiguousarray(lines).view(layout.element).astype(np.float64).reshape(-1, layout.cols, 2 if layout.complex else 1)
    chosen = values[keep_rows - first][:, cols]
    re = chosen[:, :, 0].ravel()
    im = chosen[:, :, 1].ravel() if layout.complex else np.zeros(len(re))
    places = [np.repeat(keep_rows, len(cols)), np.tile(cols, len(keep_rows))]
    return pa.RecordBatch.from_arrays([*map(pa.array, reversed(places) if layout.turned else places), pa.array(re), pa.array(im)], names=["r", "c", "re", "im"])


@dataclass
class RowBlock(InputPartition):
    first: int
    last: int


class RasterReader(DataSourceReader):
    """Bounds on r and c and strides never read what they leave out."""

    def __init__(self, path: str, layout: Layout, options: dict):
        self.path, self.layout = path, layout
        #: Stored rows and columns by the names of the image's.
        self.named = {"r": "c", "c": "r"} if layout.turned else {"r": "r", "c": "c"}
        self.low, self.high = {"r": 0, "c": 0}, {"r": layout.rows - 1, "c": layout.cols - 1}
        self.stride = {self.named["r"]: int(options.get("rowstride", 1)), self.named["c"]: int(options.get("colstride", 1))}

    def pushFilters(self, filters):
        for f in filters:
            name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
            if len(name) == 1 and name[0] in self.low and isinstance(value, int):
                n = self.named[name[0]]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low[n] = max(self.low[n], value + isinstance(f, GreaterThan))
                    continue
                if isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high[n] = min(self.high[n], value - isinstance(f, LessThan))
                    continue
                if isinstance(f, EqualTo):
                    self.low[n], self.high[n] = max(self.low[n], value), min(self.high[n], value)
                    continue
            yield f

    def partitions(self):
        step = max(1, BLOCK // max(1, self.layout.row_bytes))
        return [RowBlock(k, min(k + step, self.high["r"] + 1) - 1) for k in range(self.low["r"], self.high["r"] + 1, step)]

    def read(self, partition: RowBlock) -> Iterator[pa.RecordBatch]:
        step = self.stride["r"]
        rows = np.arange(-(-partition.first // step) * step, partition.last + 1, step)
        col_step = self.stride["c"]
        cols = np.arange(-(-self.low["c"] // col_step) * col_step, self.high["c"] + 1, col_step)
        if not len(rows) or not len(cols):
            return
        width = self.layout.row_bytes
        if step == 1:
            for first, last in pieces(partition.first, partition.last, self.layout.cols):
                raw = read_bytes(self.path, self.layout.offset + first * width, (last - first + 1) * width)
                yield pixel_batch(raw, self.layout, first, rows[first - partition.first : last - partition.first + 1], cols)
            return
        for r in rows.tolist():
            yield pixel_batch(read_bytes(self.path, self.layout.offset + r * width, width), self.layout, r, np.array([r]), cols)


class RasterSource(DataSource):
    """Formats give name() and layout(path, options)."""

    def layout(self, path: str) -> Layout:
        raise NotImplementedError

    def schema(self):
        return "r long, c long, re double, im double"

    def reader(self, schema):
        path = self.options["path"]
        return RasterReader(path, self.layout(path), self.options)


class FlatSource(RasterSource):
    """A raster whose geometry the options give: rows, cols, element, complex, offset, bigendian."""

    @classmethod
    def name(cls):
        return "flatraster"

    def layout(self, path: str) -> Layout:
        o = self.options
        order = ">" if o.get("bigendian", "false").lower() == "true" else "<"
        return Layout(int(o["rows"]), int(o["cols"]), order + ELEMENTS[o.get("element", "float32")], o.get("complex", "true").lower() == "true", int(o.get("offset", 0)))


def file_size(path: str) -> int:
    with opened(path) as f:
        return f.size()
