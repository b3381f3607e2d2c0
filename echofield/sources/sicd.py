"""Complex images in NITF files with an XML description.

An image may lie in several segments of rows. Only the fields that locate segments are
read; pixels come in partitions, and bounds and strides are pushed down to bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .blocks import BLOCK, Layout, RasterReader, RowBlock, pieces, pixel_batch, read_bytes
from .patches import block_patches, strip_lines, write_patches

# Where fields stand in the file header and in image subheaders.
IMAGES_AT, ROWS_AT, COLS_AT = 360, 333, 341

ELEMENTS = {"RE32F_IM32F": ">f4", "RE16I_IM16I": ">i2", "AMP8I_PHS8I": "u1"}

#: Most bytes and rows of a segment, and segments of a file.
SEGMENT_BYTES, SEGMENT_ROWS, SEGMENTS = 9_999_999_998, 99_999, 999


@dataclass(frozen=True)
class Segment:
    first: int
    rows: int
    offset: int


@dataclass(frozen=True)
class Image:
    cols: int
    pixel_type: str
    segments: list[Segment]
    xml: str

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)


def read_image(path: str) -> Image:
    """Segments and XML of a file."""
    head = read_bytes(path, 0, 1 << 16)
    if head[:9] not in (b"NITF02.10", b"NSIF01.00"):
        raise ValueError(f"{path} is not NITF 2.1")
    at = IMAGES_AT

    def field(width: int) -> int:
        nonlocal at
        at += width
        return int(head[at - width : at])

    def lengths(sub: int, data: int) -> list[tuple[int, int]]:
        return [(field(sub), field(data)) for _ in range(field(3))]

    header_length = int(head[354:360])
    images, graphics = lengths(6, 10), lengths(4, 6)
    field(3)
    texts, extensions = lengths(4, 5), lengths(4, 9)
    place, first, segments, cols = header_length, 0, [], 0
    for sub, data in images:
        subheader = read_bytes(path, place, sub)
        rows, cols = int(subheader[ROWS_AT : ROWS_AT + 8]), int(subheader[COLS_AT : COLS_AT + 8])
        segments.append(Segment(first, rows, place + sub))
        first += rows
        place += sub + data
    place += sum(a + b for a, b in graphics + texts)
    xml = ""
    for sub, data in extensions:
        content = read_bytes(path, place + sub, data).decode("utf-8", "replace")
        if not xml and re.search(r"<SICD[\s>]", content):
            xml = content
        place += sub + data
    kind = re.search(r"<PixelType>\s*(\w+)\s*<", xml)
    if not kind:
        raise ValueError(f"{path} has no description of complex pixels")
    return Image(cols, kind[1], segments, xml)


class SicdReader(RasterReader):
    def __init__(self, path: str, image: Image, options: dict):
        self.image = image
        super().__init__(path, Layout(image.rows, image.cols, ELEMENTS[image.pixel_type], True, 0), options)

    def partitions(self):
        step = max(1, BLOCK // max(1, self.layout.row_bytes))
        out = []
        for s in self.image.segments:
            low, high = max(s.first, self.low["r"]), min(s.first + s.rows - 1, self.high["r"])
            out += [RowBlock(k, min(k + step - 1, high)) for k in range(low, high + 1, step)]
        return out

    def read(self, partition: RowBlock) -> Iterator[pa.RecordBatch]:
        s = next(x for x in self.image.segments if x.first <= partition.first < x.first + x.rows)
        step, col_step = self.stride["r"], self.stride["c"]
        rows = np.arange(-(-partition.first // step) * step, partition.last + 1, step)
        cols = np.arange(-(-self.low["c"] // col_step) * col_step, self.high["c"] + 1, col_step)
        if not len(rows) or not len(cols):
            return
        width = self.layout.row_bytes
        for first, last in pieces(partition.first, partition.last, self.layout.cols):
            kept = rows[(rows >= first) & (rows <= last)]
            if not len(kept):
                continue
            raw = read_bytes(self.path, s.offset + (first - s.first) * width, (last - first + 1) * width)
            batch = pixel_batch(raw, self.layout, first, kept, cols)
            if self.image.pixel_type == "AMP8I_PHS8I":
                amplitude, phase = (batch.column(k).to_numpy() for k in (2, 3))
                z = amplitude * np.exp(2j * np.pi * phase / 256)
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z.real), pa.array(z.imag)], names=["r", "c", "re", "im"])
            yield batch


class SicdSource(DataSource):
    @classmethod
    def name(cls):
        return "sicd"

    def schema(self):
        return "r long, c long, re double, im double"

    def reader(self, schema):
        path = self.options["path"]
        return SicdReader(path, read_image(path), self.options)


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SicdSource)


def metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, xml) of files; the header is read where the path is."""

    def read(batches: Iterator) -> Iterator:
        for batch in batches:
            yield batch.assign(xml=[read_image(p).xml for p in batch["path"]])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(read, "path string, xml string")


# Writing


def _padded(fields: list[tuple[object, int]]) -> bytes:
    """Numbers get zeros on the left, texts spaces on the right."""
    return "".join(str(v).rjust(w, "0")[:w] if isinstance(v, int) else str(v).ljust(w)[:w] for v, w in fields).encode()


SECURITY = [("U", 1), ("", 166)]


def _image_header(rows: int, cols: int, element: str, place: int) -> bytes:
    kind, bits = {">f4": ("R", 32), ">i2": ("SI", 16), "u1": ("INT", 8)}[element]
    block = lambda n: n if n <= 8192 else 0
    fields = [("IM", 2), (f"SICD{place:03d}", 10), ("", 14), ("", 17), ("", 80), *SECURITY, (0, 1), ("", 42), (rows, 8), (cols, 8), (kind, 3), ("NODISPLY", 8), ("SAR", 8), (bits, 2), ("R", 1), (" ", 1), (0, 1), ("NC", 2), (2, 1)]
    for name in ("I", "Q") if element != "u1" else ("M", "P"):
        fields += [("", 2), (name, 6), ("N", 1), ("", 3), (0, 1)]
    fields += [(0, 1), ("P", 1), (1, 4), (1, 4), (block(cols), 4), (block(rows), 4), (bits, 2), (place, 3), (place - 1, 3), (f"{0:05d}{0:05d}", 10), ("1.0", 4), (0, 5), (0, 5)]
    return _padded(fields)


def _amplitude_and_phase(values: np.ndarray) -> np.ndarray:
    z = values[..., 0] + 1j * values[..., 1]
    return np.round(np.stack([np.minimum(np.abs(z), 255), np.angle(z) * 128 / np.pi % 256], -1)) % 256


def write_sicd(px: DataFrame, path: str, rows: int, cols: int, pixel_type: str = "RE32F_IM32F", segment_rows: int = SEGMENT_ROWS) -> None:
    """One file, written in place by tasks; missing pixels are zeros.

    Segments have at most segment_rows, or more if the file couldn't hold so many of them.
    """
    element = ELEMENTS[pixel_type]
    width = 2 * np.dtype(element).itemsize * cols
    most = max(1, min(max(segment_rows, -(-rows // SEGMENTS)), SEGMENT_ROWS, SEGMENT_BYTES // width))
    sizes = [min(most, rows - k) for k in range(0, rows, most)]
    xml = f'<SICD xmlns="urn:SICD:1.3.0"><ImageData><PixelType>{pixel_type}</PixelType><NumRows>{rows}</NumRows><NumCols>{cols}</NumCols><FirstRow>0</FirstRow><FirstCol>0</FirstCol></ImageData></SICD>'.encode()
    headers = [_image_header(n, cols, element, k + 1) for k, n in enumerate(sizes)]
    des = _padded([("DE", 2), ("XML_DATA_CONTENT", 25), (1, 2), *SECURITY, (0, 4)])
    counts = [(len(sizes), 3), *[f for h, n in zip(headers, sizes, strict=True) for f in ((len(h), 6), (n * width, 10))], (0, 3), (0, 3), (0, 3), (1, 3), (len(des), 4), (len(xml), 9), (0, 3), (0, 5), (0, 5)]
    header_length = IMAGES_AT + sum(w for _, w in counts)
    total = header_length + sum(len(h) + n * width for h, n in zip(headers, sizes, strict=True)) + len(des) + len(xml)
    start = [("NITF02.10", 9), (3, 2), ("BF01", 4), ("ECHOFIELD", 10), ("", 14), ("", 80), *SECURITY, (0, 5), (0, 5), (0, 1), ("", 3), ("", 24), ("", 18), (total, 12), (header_length, 6)]
    # Strips of lines don't cross segments: each segment begins a strip of its own.
    lines = strip_lines(width, most)
    strips = -(-most // lines)
    ends = np.cumsum([header_length] + [len(h) + n * width for h, n in zip(headers, sizes, strict=True)]).tolist()
    segment, strip = F.floor(F.col("i") / strips), F.col("i") % strips
    at = header_length + segment * (len(headers[0]) + most * width) + len(headers[0]) + strip * lines * width
    inside = px.where(F.col("r").between(0, rows - 1))
    placed = inside.select((F.floor(F.col("r") / most) * strips * lines + F.col("r") % most).alias("r"), "c", "re", "im")
    stored = lambda i: min(lines, sizes[i // strips] - i % strips * lines)
    patches = block_patches(placed, len(sizes) * strips * lines, cols, (lines, cols), element, at, convert=_amplitude_and_phase if element == "u1" else None, stored=stored)
    write_patches(patches, path, total, _padded(start + counts), [*zip(ends, headers, strict=False), (ends[-1], des + xml)])
