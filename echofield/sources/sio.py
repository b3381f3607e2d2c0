"""SIO rasters: five 32-bit numbers, optional user data, then samples by row."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from .blocks import Layout, RasterSource, read_bytes
from .patches import line_patches, write_patches

# The first number, without and with user data; read the other way round
# it tells the other byte order.
MAGIC, MAGIC_USER = 0xFF017FFE, 0xFF027FFD

KIND = {1: "u", 2: "i", 3: "f"}


def sio_layout(path: str) -> Layout:
    head = read_bytes(path, 0, 20)
    for order in (">", "<"):
        magic, rows, cols, kind, size = struct.unpack(order + "5I", head)
        if magic in (MAGIC, MAGIC_USER):
            break
    else:
        raise ValueError(f"{path} is not SIO")
    complex_, unit = kind // 10 == 1, kind % 10
    if kind // 10 > 1 or unit not in KIND:
        raise ValueError(f"SIO type {kind} is not supported")
    offset = 20 + (_user_bytes(path, order) if magic == MAGIC_USER else 0)
    return Layout(rows, cols, f"{order}{KIND[unit]}{size // (2 if complex_ else 1)}", complex_, offset)


def _user_bytes(path: str, order: str) -> int:
    """Pairs of a name and a value, each after its length."""
    at = 20
    (pairs,) = struct.unpack(order + "I", read_bytes(path, at, 4))
    at += 4
    for _ in range(2 * pairs):
        (n,) = struct.unpack(order + "I", read_bytes(path, at, 4))
        at += 4 + n
    return at - 20


class SioSource(RasterSource):
    @classmethod
    def name(cls):
        return "sio"

    def layout(self, path: str) -> Layout:
        return sio_layout(path)


def write_sio(px: DataFrame, path: str, rows: int, cols: int) -> None:
    """One file of big-endian complex floats, written in place by tasks; missing pixels are zeros."""
    head = struct.pack(">5I", MAGIC, rows, cols, 13, 8)
    write_patches(line_patches(px, rows, cols, ">f4", len(head)), path, len(head) + 8 * rows * cols, head)
