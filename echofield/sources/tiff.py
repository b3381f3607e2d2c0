"""Uncompressed TIFF rasters: real, or complex as two samples a pixel or one complex sample."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Layout, RasterSource, read_bytes
from .patches import block_patches, line_patches, write_patches

# Tags, and for each field type its letter.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, PLANAR, FORMAT = 256, 257, 258, 259, 273, 277, 279, 284, 339
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "2I", 6: "b", 7: "c", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
# Sample formats; complex ones have two numbers.
UNSIGNED, SIGNED, FLOAT, COMPLEX_INT, COMPLEX_FLOAT = 1, 2, 3, 5, 6


def tags(path: str) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first image."""
    head = read_bytes(path, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError(f"{path} is not TIFF")
    (at,) = struct.unpack(order + "I", head[4:])
    (n,) = struct.unpack(order + "H", read_bytes(path, at, 2))
    raw, out = read_bytes(path, at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", raw[12 * k : 12 * k + 8])
        if kind not in TYPES:
            continue
        size = struct.calcsize(order + TYPES[kind]) * count
        value = raw[12 * k + 8 : 12 * k + 12][:size] if size <= 4 else read_bytes(path, struct.unpack(order + "I", raw[12 * k + 8 : 12 * k + 12])[0], size)
        out[tag] = struct.unpack(order + TYPES[kind] * count, value)
    return order, out


def tiff_layout(path: str) -> Layout:
    order, found = tags(path)
    if found.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed TIFF is not supported")
    samples, kind = found.get(SAMPLES, (1,))[0], found.get(FORMAT, (UNSIGNED,))[0]
    if samples > 2 or samples == 2 and found.get(PLANAR, (1,))[0] != 1:
        raise ValueError("bands beside each other are not supported")
    complex_ = samples == 2 or kind in (COMPLEX_INT, COMPLEX_FLOAT)
    bits = found[BITS][0] // (2 if kind in (COMPLEX_INT, COMPLEX_FLOAT) else 1)
    letter = {UNSIGNED: "u", SIGNED: "i", FLOAT: "f", COMPLEX_INT: "i", COMPLEX_FLOAT: "f"}[kind]
    offsets, counts = found[OFFSETS], found[COUNTS]
    if any(a + n != b for a, n, b in zip(offsets, counts, offsets[1:], strict=False)):
        raise ValueError("strips that don't follow each other are not supported")
    return Layout(found[HEIGHT][0], found[WIDTH][0], f"{order}{letter}{bits // 8}", complex_, offsets[0])


class TiffSource(RasterSource):
    @classmethod
    def name(cls):
        return "tiffraster"

    def layout(self, path: str) -> Layout:
        return tiff_layout(path)


def _head(rows: int, cols: int, element: str, strip_rows: int) -> tuple[bytes, int]:
    """What stands in front of complex numbers as two samples a pixel, in strips, and where those begin."""
    order, kind = element[0], {"f": FLOAT, "i": SIGNED, "u": UNSIGNED}[element[1]]
    width = 2 * int(element[2]) * cols
    firsts = range(0, rows, strip_rows)
    n = len(firsts)
    lists_at = 8 + 2 + 12 * 10 + 4
    data_at = lists_at + 8 * n
    offsets = [data_at + k * width for k in firsts]
    counts = [width * (min(k + strip_rows, rows) - k) for k in firsts]
    where = lambda values, at: (values[0] if n == 1 else at)
    bits = int(element[2]) * 8
    entries = [
        (WIDTH, 4, 1, cols),
        (HEIGHT, 4, 1, rows),
        (BITS, 3, 2, bits | bits << 16),
        (COMPRESSION, 3, 1, 1),
        (OFFSETS, 4, n, where(offsets, lists_at)),
        (SAMPLES, 3, 1, 2),
        (278, 4, 1, strip_rows),
        (COUNTS, 4, n, where(counts, lists_at + 4 * n)),
        (PLANAR, 3, 1, 1),
        (FORMAT, 3, 2, kind | kind << 16),
    ]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries))
    for tag, type_, count, value in entries:
        short = type_ == 3
        packed = struct.pack(order + "HH", value & 0xFFFF, value >> 16) if short else struct.pack(order + "I", value)
        out += struct.pack(order + "HHI", tag, type_, count) + packed
    return out + struct.pack(order + "I", 0) + struct.pack(f"{order}{n}I", *offsets) + struct.pack(f"{order}{n}I", *counts), data_at


def write_tiff(path: str, values: np.ndarray, element: str = "<f4", strip_rows: int = 16) -> None:
    """Complex numbers as two samples a pixel, in strips, for tests and exchange."""
    head, _ = _head(*values.shape, element, strip_rows)
    pixels = np.stack([values.real, values.imag], axis=-1)
    body = (pixels if element[1] == "f" else np.round(pixels)).astype(element).tobytes()
    with open(path, "wb") as f:
        f.write(head + body)


def write_pixels(px: DataFrame, path: str, rows: int, cols: int, element: str = "<f4", strip_rows: int = 1024) -> None:
    """As write_tiff, of an image of any size, written in place by tasks."""
    head, data_at = _head(rows, cols, element, strip_rows)
    write_patches(line_patches(px, rows, cols, element, data_at), path, data_at + rows * cols * 2 * int(element[2]), head)


def write_complex_shorts(px: DataFrame, path: str, rows: int, cols: int) -> None:
    """Whole complex numbers as one sample a pixel, written in place by tasks."""
    size, data_at, lines = 4 * cols, 256, max(1, (1 << 16) // (4 * cols))
    padded = -(-rows // lines) * lines
    entries = [
        (WIDTH, 4, cols), (HEIGHT, 4, rows), (BITS, 3, 32), (COMPRESSION, 3, 1), (OFFSETS, 4, data_at), (SAMPLES, 3, 1),
        (278, 4, rows), (COUNTS, 4, rows * size), (PLANAR, 3, 1), (FORMAT, 3, COMPLEX_INT),
    ]
    head = b"II" + struct.pack("<HIH", 42, 8, len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + bytes(4)
    write_patches(block_patches(px, rows, cols, (lines, cols), "<i2", data_at + F.col("i") * lines * size), path, data_at + padded * size, head)
