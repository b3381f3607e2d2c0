"""NITF files of one or more images, by their image subheaders.

A grammar of counted and conditional fields reads a subheader. Each image becomes a grid
of blocks in one of four interleaves; masked files say where each block is. Pixels can be
complex, pairs of bands (in-phase and quadrature, or magnitude and phase), the upper
halves of complex floats, values behind a look-up table, or real bands.
"""

from __future__ import annotations

import struct
from collections import ChainMap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from . import blocks
from .patches import block_patches, line_patches, write_patches
from .tiles import SCHEMA, Image, Place, TileReader, block_place

# Fields of subheaders, with their widths and the kind of each: text, number
# or bytes. A width may be a name of a field before it, less a number; an entry with a list
# repeats its fields as often as the field in front says, or stands if the condition holds.
T, N, B = "text", "number", "bytes"
BAND = [
    ("IREPBAND", 2, T), ("ISUBCAT", 6, T), ("IFC", 1, T), ("IMFLT", 3, T), ("NLUTS", 1, N),
    ("if", lambda h: h["NLUTS"] > 0, [("NELUT", 5, N), ("tables", "NLUTS", [("LUTD", "NELUT", B)])]),
]
SECURITY_21 = [("ISCLAS", 1, T), ("security", 166, T)]
SECURITY_20 = [("ISCLAS", 1, T), ("security", 160, T), ("ISDWNG", 6, T), ("if", lambda h: h["ISDWNG"] == "999998", [("ISDEVT", 40, T)])]


def _subheader(security: list, no_corners: tuple[str, ...]) -> list:
    return [
        ("IM", 2, T), ("IID1", 10, T), ("IDATIM", 14, T), ("TGTID", 17, T), ("IID2", 80, T), *security, ("ENCRYP", 1, T), ("ISORCE", 42, T),
        ("NROWS", 8, N), ("NCOLS", 8, N), ("PVTYPE", 3, T), ("IREP", 8, T), ("ICAT", 8, T), ("ABPP", 2, N), ("PJUST", 1, T),
        ("ICORDS", 1, T), ("if", lambda h: h["ICORDS"] not in no_corners, [("IGEOLO", 60, T)]),
        ("NICOM", 1, N), ("comments", "NICOM", [("ICOM", 80, T)]),
        ("IC", 2, T), ("if", lambda h: h["IC"] not in ("NC", "NM"), [("COMRAT", 4, T)]),
        ("NBANDS", 1, N), ("if", lambda h: h["NBANDS"] == 0, [("XBANDS", 5, N)]), ("bands", lambda h: h["NBANDS"] or h["XBANDS"], BAND),
        ("ISYNC", 1, T), ("IMODE", 1, T), ("NBPR", 4, N), ("NBPC", 4, N), ("NPPBH", 4, N), ("NPPBV", 4, N), ("NBPP", 2, N),
        ("IDLVL", 3, N), ("IALVL", 3, N), ("ILOC", 10, T), ("IMAG", 4, T),
        ("UDIDL", 5, N), ("if", lambda h: h["UDIDL"] > 0, [("UDOFL", 3, N), ("UDID", ("UDIDL", 3), B)]),
        ("IXSHDL", 5, N), ("if", lambda h: h["IXSHDL"] > 0, [("IXSOFL", 3, N), ("IXSHD", ("IXSHDL", 3), B)]),
    ]


SUBHEADERS = {"02.10": _subheader(SECURITY_21, ("",)), "01.00": _subheader(SECURITY_21, ("",)), "02.00": _subheader(SECURITY_20, ("", "N"))}

# Places of fields in an extension of complex images' parameters.
CMETAA = {"CMPLX_MAG_REMAP_TYPE": (156, 4), "CMPLX_LIN_SCALE": (160, 7), "CMPLX_LINLOG_TP": (174, 5), "IF_RANGE_DATA": (458, 7)}
# Lines backwards, samples backwards, exchanged, by the direction of range.
TURNS = {"ROW_INC": (False, False, False), "ROW_DEC": (True, True, False), "COL_INC": (True, False, True), "COL_DEC": (False, True, True)}
NO_BLOCK = 0xFFFFFFFF
#: What a count of blocks can say. An image of more blocks down has 0 there, which is ours: the lines tell their number.
MOST_BLOCKS = 9999


def parsed(raw: bytes, grammar: list) -> tuple[dict, int]:
    """Fields by name, and how many bytes they take. Repeated fields are lists of such."""
    at, out = 0, {}

    def walk(grammar: list, scope: ChainMap) -> None:
        nonlocal at
        for name, extent, kind in grammar:
            if name == "if":
                if extent(scope):
                    walk(kind, scope)
            elif isinstance(kind, list):
                scope[name] = [{} for _ in range(extent(scope) if callable(extent) else scope[extent])]
                for each in scope[name]:
                    walk(kind, scope.new_child(each))
            else:
                width = extent if isinstance(extent, int) else scope[extent] if isinstance(extent, str) else scope[extent[0]] - extent[1]
                value = raw[at : at + width]
                at += width
                scope[name] = value if kind == B else int(value.strip() or 0) if kind == N else value.decode("latin-1").strip()

    walk(grammar, ChainMap(out))
    return out, at


def extensions(raw: bytes) -> dict[str, bytes]:
    """Tagged extensions one behind the other; of equal tags the first."""
    at, out = 0, {}
    while at + 11 <= len(raw):
        tag, n = raw[at : at + 6].decode("latin-1").strip(), int(raw[at + 6 : at + 11])
        out.setdefault(tag, raw[at + 11 : at + 11 + n])
        at += 11 + n
    return out


@dataclass(frozen=True)
class Segment:
    """An image of a file: its fields, and where its samples begin."""

    number: int
    fields: dict
    data: int
    bytes: int
    blocks: tuple[int, ...] | None  # offsets of masked blocks

    @property
    def rows(self) -> int:
        return self.fields["NROWS"]

    @property
    def cols(self) -> int:
        return self.fields["NCOLS"]


def segments(path: str) -> list[Segment]:
    """The images of a file; only headers are read."""
    head = blocks.read_bytes(path, 0, 1 << 16)
    version = head[4:9].decode("latin-1")
    if head[:4] not in (b"NITF", b"NSIF") or version not in SUBHEADERS:
        raise ValueError(f"{path} is not NITF")
    # A downgrade by event takes 40 bytes more in version 2.0.
    at = 354 + 40 * (version == "02.00" and head[280:286] == b"999998")
    place, n = int(head[at : at + 6]), int(head[at + 6 : at + 9])
    sizes = [(int(head[at + 9 + 16 * k :][:6]), int(head[at + 15 + 16 * k :][:10])) for k in range(n)]
    out = []
    for number, (sub, data) in enumerate(sizes):
        fields, _ = parsed(blocks.read_bytes(path, place, sub), SUBHEADERS[version])
        fields["extensions"] = extensions(fields.get("UDID", b"")) | extensions(fields.get("IXSHD", b""))
        begin, masked = place + sub, None
        if "M" in fields["IC"]:
            skip, blocks_width, pads_width, pad_bits = struct.unpack(">IHHH", blocks.read_bytes(path, begin, 10))
            count = fields["NBPR"] * fields["NBPC"] * (len(fields["bands"]) if fields["IMODE"] == "S" else 1)
            if blocks_width:
                raw = blocks.read_bytes(path, begin + 10 + (pad_bits + 7) // 8, 4 * count)
                masked = struct.unpack(f">{count}I", raw)
            begin += skip
        out.append(Segment(number, fields, begin, data, masked))
        place += sub + data
    return out


def _remap(fields: dict) -> dict[str, str]:
    raw = fields["extensions"].get("CMETAA")
    return {name: raw[at : at + n].decode("latin-1").strip() for name, (at, n) in CMETAA.items()} if raw else {}


def _pixels(f: dict) -> tuple[str, tuple, int, int]:
    """Element, pixels, bands and stored planes of an image."""
    bands, kind, size = f["bands"], f["PVTYPE"], f["NBPP"] // 8
    n = len(bands)
    order = "".join(b["ISUBCAT"] for b in bands)
    if kind == "C":
        if f["NBPP"] == 32 or f["IC"] == "C0" and f["COMRAT"] in ("C32", "03.1"):
            return ">u2", ("half",), n, 2 * n
        return f">f{size // 2}", ("iq",), n, 2 * n
    element = {"INT": ">u", "SI": ">i", "R": ">f"}.get(kind, "?") + str(size)
    if element[1] not in "uif" or f["IC"] not in ("NC", "NM"):
        raise ValueError(f"{kind} pixels compressed by {f['IC']} are not supported")
    if n > 1 and n % 2 == 0 and (order == "IQ" * (n // 2) or n == 2 and not order):
        return element, ("iq",), n // 2, n
    if n == 2 and order in ("MP", "PM"):
        found = _remap(f)
        number = lambda name, other: float(found.get(name) or other)
        turn = 1.0 if kind == "R" else 2.0 ** f["NBPP"]
        return element, ("polar", order.index("M"), turn, found.get("CMPLX_MAG_REMAP_TYPE") or "LINM", number("CMPLX_LIN_SCALE", 1), number("CMPLX_LINLOG_TP", 0)), 1, 2
    tables = [t["LUTD"] for t in bands[0].get("tables", [])] if n == 1 else []
    if tables:
        value = [tuple(a << 8 | b for a, b in zip(*tables[:2], strict=True))] if len(tables) == 2 else [tuple(t) for t in tables]
        return element, ("table", tuple(value)), len(value), 1
    return element, ("real",), n, n


def image_of(s: Segment, oriented: bool) -> tuple[Image, int]:
    f = s.fields
    element, pixels, bands, planes = _pixels(f)
    turn = TURNS.get(_remap(f).get("IF_RANGE_DATA", "ROW_DEC"), TURNS["ROW_INC"]) if oriented else TURNS["ROW_INC"]
    tile = (f["NPPBV"] or f["NROWS"], f["NPPBH"] or f["NCOLS"])
    return Image(s.number, f["NROWS"], f["NCOLS"], *tile, element, pixels, bands, turn), planes


INTERLEAVES = {"P": "pixel", "R": "line", "B": "block", "S": "sequence"}


class NitfReader(TileReader):
    def __init__(self, path: str, options: dict):
        self.segments = segments(path)
        made = [image_of(s, options.get("oriented", "true").lower() == "true") for s in self.segments]
        self.planes = [n for _, n in made]
        super().__init__(path, [image for image, _ in made], options)

    def place(self, image: Image, i: int, j: int) -> Place | None:
        s, n = self.segments[image.number], self.planes[image.number]
        mode = s.fields["IMODE"]
        plain = block_place(image, s.data, i, j, INTERLEAVES[mode] if image.pixels[0] not in ("half",) and s.fields["PVTYPE"] != "C" else "pixel", n)
        if s.blocks is None:
            return plain
        number, count = i * image.grid[1] + j, image.grid[0] * image.grid[1]
        if mode == "S":
            starts = [s.blocks[k * count + number] for k in range(n)]
            return None if NO_BLOCK in starts else Place(tuple(s.data + x for x in starts), plain.line, plain.sample)
        if s.blocks[number] == NO_BLOCK:
            return None
        moved = s.data + s.blocks[number] - plain.planes[0]
        return Place(tuple(p + moved for p in plain.planes), plain.line, plain.sample)


class NitfSource(DataSource):
    """All images, or those with a bound on ``image``; ``oriented`` turns them view from above."""

    @classmethod
    def name(cls):
        return "nitf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return NitfReader(self.options["path"], self.options)


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NitfSource)


TABLE = "path string, image int, id string, rows long, cols long, kind string, bits int, bands int, subcategories string, tables int, mode string, block_rows long, block_cols long, data long, bytes long, extensions string"


def segment_table(files: DataFrame) -> DataFrame:
    """A row for each image of the files at ``path``; headers are read where the row is."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                for s in segments(path):
                    f = s.fields
                    tables = sum(b["NLUTS"] for b in f["bands"])
                    subs = ",".join(b["ISUBCAT"] for b in f["bands"])
                    out.append((path, s.number, f["IID1"], s.rows, s.cols, f["PVTYPE"], f["NBPP"], len(f["bands"]), subs, tables, f["IMODE"], f["NPPBV"] or s.rows, f["NPPBH"] or s.cols, s.data, s.bytes, ",".join(f["extensions"])))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in TABLE.split(", ")])

    return files.select("path").mapInPandas(read, TABLE)


# Writing


@dataclass(frozen=True)
class Written:
    """How an image is written: kind and bits of a number, categories of its bands, blocks and interleave."""

    rows: int
    cols: int
    kind: str = "R"
    bits: int = 32
    bands: tuple[str, ...] = ("I", "Q")
    mode: str = "P"
    block: tuple[int, int] | None = None
    table: bytes = b""
    extension: bytes = b""
    planes: tuple[str, ...] = ("re", "im")

    @property
    def element(self) -> str:
        if self.kind == "C":
            return ">u2" if self.bits == 32 else f">f{self.bits // 16}"
        return {"R": ">f", "SI": ">i", "INT": ">u"}[self.kind] + str(self.bits // 8)

    @property
    def shape(self) -> tuple[int, int]:
        return self.block or (self.rows, self.cols)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.rows // self.shape[0]), -(-self.cols // self.shape[1])

    @property
    def block_bytes(self) -> int:
        return self.shape[0] * self.shape[1] * len(self.planes) * np.dtype(self.element).itemsize

    def subheader(self, number: int) -> bytes:
        out = [text("IM", 2), text(f"IMAGE{number:03d}", 10), text("", 14 + 17 + 80), text("U", 1), text("", 166), b"0", text("", 42)]
        out += [digits(self.rows, 8), digits(self.cols, 8), text(self.kind, 3), text("NODISPLY", 8), text("SAR", 8), digits(self.bits, 2), b"R", b" ", b"0", b"NC"]
        out.append(digits(len(self.bands), 1))
        for name in self.bands:
            out += [text("", 2), text(name, 6), b"N", text("", 3), digits(1, 1) + digits(len(self.table), 5) + self.table if self.table else b"0"]
        (down, across), (lines, samples) = self.grid, self.shape
        out += [b"0", text(self.mode, 1), digits(across, 4), digits(down if down <= MOST_BLOCKS else 0, 4), digits(samples if self.block else 0, 4), digits(lines if self.block else 0, 4), digits(self.bits, 2)]
        out += [digits(number + 1, 3), digits(number, 3), b"0000000000", text("1.0", 4), digits(0, 5)]
        out.append(digits(len(self.extension) + 3, 5) + b"000" + self.extension if self.extension else digits(0, 5))
        return b"".join(out)


def text(value: str, width: int) -> bytes:
    return value.encode("latin-1").ljust(width)[:width]


def digits(value: int, width: int) -> bytes:
    return str(value).zfill(width).encode()


def range_direction(direction: str, remap: str = "LINM", scale: float = 1.0, knee: float = 0.0) -> bytes:
    """An extension that says how magnitudes are kept and which way range runs."""
    raw = bytearray(b" " * 1500)
    for name, value in zip(CMETAA, (remap, f"{scale:.5g}", f"{knee:.4g}", direction), strict=True):
        at, n = CMETAA[name]
        raw[at : at + n] = text(value, n)
    return b"CMETAA" + digits(len(raw), 5) + bytes(raw)


def _halves(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.float32).view(np.uint32) >> 16


def write_nitf(images: list[tuple[DataFrame, Written]], path: str) -> None:
    """One file; each task packs blocks and writes them in place."""
    headers = [w.subheader(k) for k, (_, w) in enumerate(images)]
    sizes = [w.grid[0] * w.grid[1] * w.block_bytes for _, w in images]
    counts = digits(len(images), 3) + b"".join(digits(len(h), 6) + digits(n, 10) for h, n in zip(headers, sizes, strict=True)) + b"000" * 5 + digits(0, 5) * 2
    header = 360 + len(counts)
    total = header + sum(map(len, headers)) + sum(sizes)
    start = text("NITF02.10", 9) + digits(3, 2) + text("BF01", 4) + text("ECHOFIELD", 10) + text("", 14 + 80) + b"U" + text("", 166) + digits(0, 10) + b"0" + text("", 3 + 24 + 18)
    head = start + digits(total, 12) + digits(header, 6) + counts
    fixed, patches, at = [], [], header
    for (px, w), sub, n in zip(images, headers, sizes, strict=True):
        fixed.append((at, sub))
        begin, across = at + len(sub), w.grid[1]
        number = F.col("i") * across + F.col("j")
        convert: Callable | None = _halves if w.element == ">u2" and w.kind == "C" else None
        if w.block is None:  # one block of any size: strips of its lines, of each plane by itself where planes lie one behind the other
            whole, item = w.mode in "PR" or w.kind == "C", np.dtype(w.element).itemsize
            for k, names in enumerate([list(w.planes)] if whole else [[name] for name in w.planes]):
                axis = 1 if w.mode == "R" and w.kind != "C" else -1
                patches.append(line_patches(px, w.rows, w.cols, w.element, begin + k * w.rows * w.cols * item, names, axis, convert))
        elif w.mode == "S":  # a part of the file for each band
            plane = w.block_bytes // len(w.planes)
            patches += [block_patches(px, w.rows, w.cols, w.shape, w.element, begin + (k * w.grid[0] * across + number) * plane, [name], 0) for k, name in enumerate(w.planes)]
        else:
            axis = {"P": -1, "R": 1, "B": 0}[w.mode] if w.kind != "C" else -1
            patches.append(block_patches(px, w.rows, w.cols, w.shape, w.element, begin + number * w.block_bytes, list(w.planes), axis, convert))
        at = begin + n
    whole = patches[0]
    for p in patches[1:]:
        whole = whole.unionByName(p)
    write_patches(whole, path, total, head, fixed)
