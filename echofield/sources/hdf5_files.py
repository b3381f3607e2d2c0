"""HDF5 files of nested groups, small values and chunked rasters.

Tasks pack and compress chunks. The driver gets each chunk's length, lays out the file,
and writes headers and indexes; tasks then write the chunks in place.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hdf5 import ATTRIBUTE, CHUNKED, CONTIGUOUS, DATASPACE, DATATYPE, DEFLATE, FILTERS, LAYOUT, NOWHERE, SHUFFLE, SIGNATURE, SYMBOLS
from .patches import block_patches, scratch_file, write_patches

#: Half the entries of a node of symbols, of a node of groups, and of one of chunks.
SYMBOL_K, GROUP_K, CHUNK_K = 16, 16, 32
FILL = 5


@dataclass
class Raster:
    """Pixels to be kept in chunks. ``axis`` says how the planes stand: as a third axis or a compound."""

    px: DataFrame
    rows: int
    cols: int
    chunk: tuple[int, int]
    element: str = "<f4"
    planes: tuple[str, ...] = ("re",)
    compound: bool = False
    deflated: bool = True


def _type(kind: np.dtype | str) -> bytes:
    if isinstance(kind, str):
        kind = np.dtype(kind)
    if kind.names:
        body = b"".join(n.encode().ljust((len(n) // 8 + 1) * 8, b"\0") + struct.pack("<I", kind.fields[n][1]) + bytes(28) + _type(kind.fields[n][0]) for n in kind.names)
        return struct.pack("<B3sI", 0x16, len(kind.names).to_bytes(3, "little"), kind.itemsize) + body
    order, bits = int(kind.str[0] == ">"), 8 * kind.itemsize
    if kind.kind == "S":
        return struct.pack("<B3sI", 0x13, bytes(3), kind.itemsize)
    if kind.kind == "f":
        # Places and widths of exponent and fraction, and the bias.
        fraction, exponent, bias = {16: (10, 5, 15), 32: (23, 8, 127), 64: (52, 11, 1023)}[bits]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | order, bits - 1, 0, kind.itemsize, 0, bits, fraction, exponent, 0, fraction, bias)
    return struct.pack("<BBBBIHH", 0x10, order | 8 * (kind.kind == "i"), 0, 0, kind.itemsize, 0, bits)


def _space(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)


def _header(messages: list[tuple[int, bytes]]) -> bytes:
    body = b"".join(struct.pack("<HHB3x", kind, -(-len(m) // 8) * 8, 0) + m.ljust(-(-len(m) // 8) * 8, b"\0") for kind, m in messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def _stored(value) -> np.ndarray:
    if isinstance(value, str):
        return np.array(value.encode().ljust(1, b"\0"))
    if isinstance(value, list) and value and isinstance(value[0], str):
        return np.array([v.encode() for v in value])
    return np.asarray(value)


class Layout:
    """Places of all parts of a file, and their bytes."""

    def __init__(self):
        self.end = 96
        self.fixed: list[tuple[int, bytes]] = []

    def room(self, n: int) -> int:
        at = self.end
        self.end += -(-n // 8) * 8
        return at

    def put(self, raw: bytes) -> int:
        at = self.room(len(raw))
        self.fixed.append((at, raw))
        return at

    def value(self, value) -> int:
        data = _stored(value)
        raw = data.tobytes()
        layout = struct.pack("<BBQQ", 3, CONTIGUOUS, self.put(raw) if raw else NOWHERE, len(raw))
        return self.put(_header([(DATASPACE, _space(data.shape)), (DATATYPE, _type(data.dtype)), (FILL, b"\x02\x02\x00\x00"), (LAYOUT, layout)]))

    def raster(self, r: Raster, lengths: list[int]) -> tuple[int, list[int]]:
        """The dataset's header, and the places of its chunks."""
        shape = (r.rows, r.cols) if r.compound or len(r.planes) == 1 else (r.rows, r.cols, len(r.planes))
        chunk = (*r.chunk, len(r.planes))[: len(shape)]
        kind = np.dtype([("r", r.element), ("i", r.element)]) if r.compound else np.dtype(r.element)
        across = -(-r.cols // r.chunk[1])
        places = [self.room(n) for n in lengths]
        keys = [struct.pack(f"<II{len(shape) + 1}Q", n, 0, k // across * chunk[0], k % across * chunk[1], *(0,) * (len(shape) - 1)) for k, n in enumerate(lengths)]
        beyond = struct.pack(f"<II{len(shape) + 1}Q", 0, 0, -(-r.rows // chunk[0]) * chunk[0], *(0,) * len(shape))
        level, nodes = 0, list(zip(keys, places, strict=True))
        while level == 0 or len(nodes) > 1:
            nodes = self._level(nodes, level, beyond)
            level += 1
        layout = struct.pack(f"<BBBQ{len(shape) + 1}I", 3, CHUNKED, len(shape) + 1, nodes[0][1] if nodes else NOWHERE, *chunk, kind.itemsize)
        messages = [(DATASPACE, _space(shape)), (DATATYPE, _type(kind)), (FILL, b"\x02\x03\x00\x00"), (LAYOUT, layout)]
        if r.deflated:
            one = struct.pack("<HHHHII", SHUFFLE, 0, 1, 1, kind.itemsize, 0)
            messages.append((FILTERS, struct.pack("<BB6x", 1, 2) + one + struct.pack("<HHHHII", DEFLATE, 0, 1, 1, 6, 0)))
        return self.put(_header(messages)), places

    def _level(self, nodes: list[tuple[bytes, int]], level: int, beyond: bytes) -> list[tuple[bytes, int]]:
        most = 2 * CHUNK_K
        width = 24 + most * 8 + (most + 1) * len(beyond)
        parts = [nodes[k : k + most] for k in range(0, len(nodes), most)]
        places = [self.room(width) for _ in parts]
        for k, part in enumerate(parts):
            left, right = places[k - 1] if k else NOWHERE, places[k + 1] if k + 1 < len(parts) else NOWHERE
            after = parts[k + 1][0][0] if k + 1 < len(parts) else beyond
            raw = struct.pack("<4sBBHQQ", b"TREE", 1, level, len(part), left, right) + b"".join(key + struct.pack("<Q", at) for key, at in part) + after
            self.fixed.append((places[k], raw.ljust(width, b"\0")))
        return [(part[0][0], at) for part, at in zip(parts, places, strict=True)]

    def group(self, members: dict[str, int], attributes: dict | None = None) -> int:
        names = sorted(members)
        heap, places = bytearray(8), {}
        for n in names:
            places[n] = len(heap)
            heap += n.encode() + b"\0"
            heap += bytes(-len(heap) % 8)
        heap_at = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), 1, self.put(bytes(heap))))
        parts = [names[k : k + 2 * SYMBOL_K] for k in range(0, len(names), 2 * SYMBOL_K)]
        if len(parts) > 2 * GROUP_K:
            raise ValueError("too many members for one node")
        children = []
        for part in parts:
            entries = b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in part)
            children.append(self.put((struct.pack("<4sBxH", b"SNOD", 1, len(part)) + entries).ljust(8 + 2 * SYMBOL_K * 40, b"\0")))
        keys = struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", at, places[part[-1]]) for at, part in zip(children, parts, strict=True))
        tree = struct.pack("<4sBBHQQ", b"TREE", 0, 0, len(parts), NOWHERE, NOWHERE) + keys
        messages = [(SYMBOLS, struct.pack("<QQ", self.put(tree.ljust(24 + (4 * GROUP_K + 1) * 8, b"\0")), heap_at))]
        for name, value in (attributes or {}).items():
            data = _stored(value)
            parts_ = [name.encode() + b"\0", _type(data.dtype), _space(data.shape)]
            padded = b"".join(p.ljust(-(-len(p) // 8) * 8, b"\0") for p in parts_)
            messages.append((ATTRIBUTE, struct.pack("<BxHHH", 1, *map(len, parts_)) + padded + data.tobytes()))
        return self.put(_header(messages))

    def head(self, root: int) -> bytes:
        sizes = struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, SYMBOL_K, GROUP_K, 0)
        return SIGNATURE + sizes + struct.pack("<QQQQ", 0, NOWHERE, self.end, NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0)


def _packed(spark: SparkSession, r: Raster) -> tuple[DataFrame, list[int]]:
    """Chunks by number, compressed, in the shared folder; and their lengths."""
    across = -(-r.cols // r.chunk[1])
    n = -(-r.rows // r.chunk[0]) * across
    raw = block_patches(r.px, r.rows, r.cols, r.chunk, r.element, F.col("i") * across + F.col("j"), list(r.planes))
    width = np.dtype(r.element).itemsize * (len(r.planes) if r.compound else 1)

    @F.pandas_udf("binary")
    def deflated(data: pd.Series) -> pd.Series:
        return data.map(lambda x: zlib.compress(np.frombuffer(x, np.uint8).reshape(-1, width).T.tobytes(), 6))

    path = "file://" + scratch_file(spark, "chunks")
    raw.withColumn("data", deflated("data") if r.deflated else F.col("data")).write.parquet(path)
    kept = spark.read.parquet(path)
    lengths = [0] * n
    for row in kept.select("at", F.octet_length("data").alias("n")).collect():
        lengths[row["at"]] = row["n"]
    return kept, lengths


def write_hdf5(spark: SparkSession, tree: dict, path: str, attributes: dict | None = None) -> None:
    """tree: nested dicts whose leaves are texts, numbers, arrays and rasters."""
    layout, patches = Layout(), []

    def member(value) -> int:
        if isinstance(value, dict):
            return layout.group({k: member(v) for k, v in value.items()})
        if not isinstance(value, Raster):
            return layout.value(value)
        kept, lengths = _packed(spark, value)
        header, places = layout.raster(value, lengths)
        where = spark.createDataFrame(list(enumerate(places)), "at long, place long")
        patches.append(kept.join(where, "at").select(F.col("place").alias("at"), "data"))
        return header

    root = layout.group({k: member(v) for k, v in tree.items()}, attributes)
    whole = patches[0]
    for p in patches[1:]:
        whole = whole.unionByName(p)
    write_patches(whole, path, layout.end, layout.head(root), layout.fixed)
