"""Rasters in HDF5 files, a partition from the chunks that a window touches.

The file's own index is walked: superblock, groups, object headers, and for a chunked
dataset the tree of chunk addresses, of which only nodes that can hold wanted lines are
read. Chunks are read and unpacked in tasks. Understood are both generations of
superblocks and object headers, compact, contiguous and chunked storage (trees of
version 1, single chunks, implicit and unpaged fixed arrays), deflate, shuffle and
checksums; numbers, fixed and variable texts and compounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from . import blocks
from .tiles import SCHEMA, Image, TileReader

# The format's signature and the numbers of its messages, filters and layouts.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS = 1, 2, 3, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
COMPACT, CONTIGUOUS, CHUNKED = 0, 1, 2
SINGLE, IMPLICIT, FIXED = 1, 2, 3
NOWHERE = (1 << 64) - 1


class Cursor:
    """Numbers one behind the other."""

    def __init__(self, raw: bytes, offset_size: int = 8, length_size: int = 8):
        self.raw, self.at, self.offset_size, self.length_size = raw, 0, offset_size, length_size

    def take(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int:
        value = self.number(self.offset_size)
        return NOWHERE if value == (1 << 8 * self.offset_size) - 1 else value

    def length(self) -> int:
        return self.number(self.length_size)

    def align(self, n: int, base: int = 0) -> None:
        self.at += -(self.at - base) % n


@dataclass
class Text:
    """A type of texts: of ``size`` bytes, or in the global heap if it is 0."""

    size: int


def datatype(c: Cursor) -> np.dtype | Text:
    head, bits, size = c.number(1), c.take(3), c.number(4)
    kind, version = head & 15, head >> 4
    order = "><"[not bits[0] & 1]
    if kind == 0:
        c.take(4)
        return np.dtype(f"{order}{'i' if bits[0] & 8 else 'u'}{size}")
    if kind == 1:
        c.take(12)
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return Text(size)
    if kind == 9:
        datatype(c)
        return Text(0)
    if kind == 6:
        names, kinds, places = [], [], []
        for _ in range(int.from_bytes(bits[:2], "little")):
            begin = c.at
            end = c.raw.index(b"\0", begin)
            names.append(c.raw[begin:end].decode())
            c.at = end + 1
            if version < 3:
                c.align(8, begin)
            places.append(c.number(4 if version < 3 else max(1, (size.bit_length() + 7) // 8)))
            if version == 1:
                c.take(28)
            kinds.append(datatype(c))
        return np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": size})
    raise ValueError(f"HDF5 types of class {kind} are not supported")


def dataspace(c: Cursor) -> tuple[int, ...]:
    version, rank = c.number(1), c.number(1)
    c.take(6 if version == 1 else 2)
    return tuple(c.length() for _ in range(rank))


@dataclass
class Dataset:
    path: str
    shape: tuple[int, ...] = ()
    type: np.dtype | Text | None = None
    storage: int = CONTIGUOUS
    address: int = NOWHERE
    size: int = 0
    chunk: tuple[int, ...] = ()
    index: int = 0  # kind of the index of chunks; 0 is the tree
    filters: list[int] = field(default_factory=list)
    data: bytes = b""
    masks: tuple[int, int] = (0, 0)  # bytes and filter mask of a single chunk
    offset_size: int = 8
    length_size: int = 8

    def cursor(self, at: int, n: int) -> Cursor:
        return Cursor(blocks.read_bytes(self.path, at, n), self.offset_size, self.length_size)

    def chunks(self, low: int, high: int) -> dict[tuple[int, ...], tuple[int, int, int]]:
        """Address, bytes and filter mask of the chunks that begin with lines low to high."""
        out: dict[tuple[int, ...], tuple[int, int, int]] = {}
        if self.address == NOWHERE:
            return out
        grid = [-(-n // m) for n, m in zip(self.shape, self.chunk, strict=True)]
        whole = int(np.prod(self.chunk)) * self.type.itemsize
        if self.index == 0:
            self._walk(self.address, low, high, out)
        elif self.index == SINGLE:
            out[(0,) * len(self.shape)] = (self.address, *self.masks) if self.filters else (self.address, whole, 0)
        else:
            places, entry = self.address, 0
            if self.index == FIXED:
                c = self.cursor(self.address, 12 + self.length_size + self.offset_size)
                c.take(5)
                client, entry, bits, count, block = c.number(1), c.number(1), c.number(1), c.length(), c.address()
                if count > 1 << bits:
                    raise ValueError("paged arrays of chunks are not supported")
                places = block + 6 + self.offset_size
                table = self.cursor(places, entry * count)
            for number in range(int(np.prod(grid))):
                key = tuple(int(k) * n for k, n in zip(np.unravel_index(number, grid), self.chunk, strict=True))
                if self.index == IMPLICIT:
                    found = (self.address + number * whole, whole, 0)
                else:
                    address = table.address()
                    found = (address, table.number(entry - self.offset_size - 4), table.number(4)) if client else (address, whole, 0)
                if low <= key[0] <= high and found[0] != NOWHERE:
                    out[key] = found
        return out

    def _walk(self, at: int, low: int, high: int, out: dict) -> None:
        rank = len(self.shape) + 1
        head = self.cursor(at, 8 + 2 * self.offset_size)
        if head.take(4) != b"TREE":
            raise ValueError(f"{self.path} has a broken tree of chunks")
        head.take(1)
        level, used = head.number(1), head.number(2)
        key = 8 + 8 * rank
        c = self.cursor(at + 8 + 2 * self.offset_size, used * (key + self.offset_size) + key)
        keys, children = [], []
        for _ in range(used):
            size, mask = c.number(4), c.number(4)
            keys.append((size, mask, tuple(c.number(8) for _ in range(rank))[:-1]))
            children.append(c.address())
        c.take(8)
        # Keys ascend by first line; the last key bounds the last child.
        firsts = [k[2][0] for k in keys] + [c.number(8)]
        for (size, mask, place), child, first, after in zip(keys, children, firsts, firsts[1:], strict=False):
            if level == 0 and low <= place[0] <= high:
                out[place] = (child, size, mask)
            elif level and first <= high and after >= low:
                self._walk(child, low, high, out)

    def unpacked(self, raw: bytes, mask: int) -> bytes:
        for k in reversed(range(len(self.filters))):
            if mask >> k & 1:
                continue
            if self.filters[k] == DEFLATE:
                raw = zlib.decompress(raw)
            elif self.filters[k] == SHUFFLE:
                n = self.type.itemsize
                whole = len(raw) // n * n
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(n, -1).T.tobytes() + raw[whole:]
            elif self.filters[k] == CHECKSUM:
                raw = raw[:-4]
            else:
                raise ValueError(f"HDF5 filter {self.filters[k]} is not supported")
        return raw

    def value(self):
        """The whole of a small dataset: a number, text, array or list of texts."""
        count = int(np.prod(self.shape)) if self.shape else 1
        width = self.type.itemsize if isinstance(self.type, np.dtype) else self.type.size or 8 + self.offset_size
        if self.storage == CHUNKED:
            out = np.zeros(self.shape, self.type)
            for key, (at, size, mask) in self.chunks(0, 1 << 62).items():
                part = np.frombuffer(self.unpacked(blocks.read_bytes(self.path, at, size), mask), self.type).reshape(self.chunk)
                spots = tuple(slice(k, min(k + n, m)) for k, n, m in zip(key, self.chunk, self.shape, strict=True))
                out[spots] = part[tuple(slice(0, s.stop - s.start) for s in spots)]
            return out
        raw = self.data if self.storage == COMPACT else blocks.read_bytes(self.path, self.address, count * width) if self.address != NOWHERE else bytes(count * width)
        if isinstance(self.type, Text):
            texts = [self._text(raw[k * width : (k + 1) * width]) for k in range(count)]
            return texts if self.shape else texts[0]
        out = np.frombuffer(raw, self.type, count)
        return out.reshape(self.shape) if self.shape else out[0].item()

    def _text(self, raw: bytes) -> str:
        if not self.type.size:
            c = Cursor(raw, self.offset_size, self.length_size)
            n, heap, wanted = c.number(4), c.address(), c.number(4)
            if not n or heap in (0, NOWHERE):
                return ""
            c = self.cursor(heap, 8 + self.length_size)
            c.take(8)
            c = self.cursor(heap, c.length())
            c.take(8 + self.length_size)
            while c.at < len(c.raw):
                number = c.number(2)
                c.take(6)
                size = c.length()
                if number == wanted:
                    raw = c.take(size)[:n]
                    break
                c.at += -(-size // 8) * 8
        return raw.split(b"\0")[0].decode("utf-8", "replace").rstrip()


class File:
    """Groups, datasets and attributes by path."""

    def __init__(self, path: str):
        self.path = path
        head = blocks.read_bytes(path, 0, 128)
        if head[:8] != SIGNATURE:
            raise ValueError(f"{path} is not HDF5")
        if head[8] < 2:
            self.sizes = head[13], head[14]
            c = Cursor(head, *self.sizes)
            c.at = 24 + 4 * (head[8] == 1) + 4 * self.sizes[0] + self.sizes[0]
        else:
            self.sizes = head[9], head[10]
            c = Cursor(head, *self.sizes)
            c.at = 12 + 3 * self.sizes[0]
        self.root = c.address()

    def _cursor(self, at: int, n: int) -> Cursor:
        return Cursor(blocks.read_bytes(self.path, at, n), *self.sizes)

    def messages(self, at: int) -> list[tuple[int, bytes]]:
        c = self._cursor(at, 16)
        modern = c.raw[:4] == b"OHDR"
        out, spans, order = [], [], False
        if modern:
            flags = c.raw[5]
            order = bool(flags & 4)
            skip = 6 + 16 * bool(flags & 32) + 4 * bool(flags & 16)
            width = 1 << (flags & 3)
            size = int.from_bytes(blocks.read_bytes(self.path, at + skip, width), "little")
            spans.append((at + skip + width, size))
        else:
            c.take(8)
            spans.append((at + 16, c.number(4)))
        while spans:
            begin, size = spans.pop(0)
            c = self._cursor(begin, size)
            while c.at + (4 if modern else 8) <= size:
                kind, n = (c.number(1), c.number(2)) if modern else (c.number(2), c.number(2))
                c.take(1 + 2 * order if modern else 4)
                body = c.take(n)
                if kind == CONTINUATION:
                    b = Cursor(body, *self.sizes)
                    place, length = b.address(), b.length()
                    spans.append((place + 4, length - 8) if modern else (place, length))
                else:
                    out.append((kind, body))
        return out

    def links(self, at: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, body in self.messages(at):
            c = Cursor(body, *self.sizes)
            if kind == SYMBOLS:
                tree, heap = c.address(), c.address()
                h = self._cursor(heap, 8 + 2 * self.sizes[1] + self.sizes[0])
                h.take(8)
                size = h.length()
                h.length()
                self._symbols(tree, blocks.read_bytes(self.path, h.address(), size), out)
            elif kind == LINK:
                flags = c.take(2)[1]
                hard = c.number(1) == 0 if flags & 8 else True
                c.take(8 * bool(flags & 4) + bool(flags & 16))
                name = c.take(c.number(1 << (flags & 3))).decode()
                if hard:
                    out[name] = c.address()
            elif kind == LINK_INFO:
                flags = c.take(2)[1]
                c.take(8 * (flags & 1))
                if c.address() != NOWHERE:
                    raise ValueError("groups in dense storage are not supported")
        return out

    def _symbols(self, at: int, names: bytes, out: dict[str, int]) -> None:
        offset, length = self.sizes
        c = self._cursor(at, 8 + 2 * offset)
        if c.take(4) == b"SNOD":
            c.take(2)
            n, entry = c.number(2), 2 * offset + 24
            e = self._cursor(at + 8, n * entry)
            for _ in range(n):
                place, header = e.address(), e.address()
                e.take(24)
                out[names[place : names.index(b"\0", place)].decode()] = header
            return
        c.take(2)
        used = c.number(2)
        c = self._cursor(at + 8 + 2 * offset, used * (length + offset))
        for _ in range(used):
            c.length()
            self._symbols(c.address(), names, out)

    def find(self, name: str) -> int | None:
        at = self.root
        for part in name.strip("/").split("/"):
            if part:
                at = self.links(at).get(part)
                if at is None:
                    return None
        return at

    def dataset(self, name: str) -> Dataset:
        at = self.find(name)
        if at is None:
            raise ValueError(f"{self.path} has no {name}")
        return self._dataset(at)

    def _dataset(self, at: int) -> Dataset:
        d = Dataset(self.path, offset_size=self.sizes[0], length_size=self.sizes[1])
        for kind, body in self.messages(at):
            c = Cursor(body, *self.sizes)
            if kind == DATASPACE:
                d.shape = dataspace(c)
            elif kind == DATATYPE:
                d.type = datatype(c)
            elif kind == FILTERS:
                d.filters = self._filters(c)
            elif kind == LAYOUT:
                self._layout(c, d)
        d.chunk = d.chunk[: len(d.shape)]
        return d

    def _filters(self, c: Cursor) -> list[int]:
        version, n, out = c.number(1), c.number(1), []
        c.take(6 * (version == 1))
        for _ in range(n):
            out.append(c.number(2))
            name = c.number(2) if version == 1 or out[-1] >= 256 else 0
            c.take(2)
            values = c.number(2)
            c.take((-(-name // 8) * 8 if version == 1 else name) + 4 * values + 4 * (version == 1 and values % 2))
        return out

    def _layout(self, c: Cursor, d: Dataset) -> None:
        version = c.number(1)
        if version < 3:
            rank, d.storage = c.number(1), c.number(1)
            c.take(5)
            d.address = c.address() if d.storage != COMPACT else NOWHERE
            d.chunk = tuple(c.number(4) for _ in range(rank))
            if d.storage == COMPACT:
                d.data = c.take(c.number(4))
            return
        d.storage = c.number(1)
        if d.storage == COMPACT:
            d.data = c.take(c.number(2))
        elif d.storage == CONTIGUOUS:
            d.address, d.size = c.address(), c.length()
        elif d.storage == CHUNKED and version == 3:
            rank, d.address = c.number(1), c.address()
            d.chunk = tuple(c.number(4) for _ in range(rank))
        elif d.storage == CHUNKED:
            flags, rank, width = c.number(1), c.number(1), c.number(1)
            d.chunk = tuple(c.number(width) for _ in range(rank))
            d.index = c.number(1)
            if d.index == SINGLE and flags & 2:
                d.masks = c.length(), c.number(4)
            elif d.index == FIXED:
                c.take(1)
            elif d.index not in (SINGLE, IMPLICIT):
                raise ValueError("this index of chunks is not supported")
            d.address = c.address()
        else:
            raise ValueError("this storage is not supported")

    def attributes(self, name: str = "/") -> dict[str, object]:
        out = {}
        for kind, body in self.messages(self.find(name)):
            if kind != ATTRIBUTE:
                continue
            c = Cursor(body, *self.sizes)
            version = c.number(1)
            c.take(1)
            sizes = [c.number(2) for _ in range(3)]
            c.take(version == 3)
            parts = []
            for n in sizes:
                parts.append(c.take(n))
                if version == 1:
                    c.take(-n % 8)
            d = Dataset(self.path, dataspace(Cursor(parts[2], *self.sizes)), datatype(Cursor(parts[1], *self.sizes)), COMPACT, offset_size=self.sizes[0], length_size=self.sizes[1])
            d.data = c.raw[c.at :]
            out[parts[0].split(b"\0")[0].decode()] = d.value()
        return out

    def value(self, name: str):
        return self.dataset(name).value()

    @cached_property
    def product(self) -> str | None:
        """Which sensor's product it is, by what the root holds."""
        found = self.links(self.root)
        if "s_i" in found and "s_q" in found:
            return "iceye"
        if "science" in found:
            return "nisar"
        if str(self.attributes().get("Mission ID", "")).strip() in ("CSK", "CSG", "KMPS", "KMP5"):
            return "csm"
        return None


# Products


@dataclass(frozen=True)
class Layer:
    """An image: datasets of its parts, and which way it is turned."""

    name: str
    datasets: tuple[str, ...]
    turn: tuple[bool, bool, bool]


def layers(file: File) -> list[Layer]:
    """The images of a product, in its order."""
    if file.product == "iceye":
        return [Layer("slc", ("s_i", "s_q"), (str(file.value("look_side")).lower() == "left", False, True))]
    if file.product == "nisar":
        root = "/science/LSAR/"
        left = str(file.value(root + "identification/lookDirection")).lower() != "right"
        found = "".join(file.value(root + "identification/listOfFrequencies"))
        swaths = [f"{root}SLC/swaths/frequency{f}/" for f in found]
        return [Layer(f"{s[-2]}:{p}", (s + p,), (left, False, True)) for s in swaths for p in file.value(s + "listOfPolarizations")]
    if file.product == "csm":
        found = file.attributes()
        early = str(found["Lines Order"]).startswith("EARLY-LATE")
        right = str(found["Look Side"]).upper().startswith("R")
        turn = (early != right, not str(found["Columns Order"]).startswith("NEAR-FAR"), True)
        name = "SBI" if str(found["Mission ID"]).strip() in ("CSK", "KMPS", "KMP5") else "IMG"
        return [Layer(g, (f"/{g}/{name}",), turn) for g in sorted(file.links(file.root)) if g[:1] == "S" and g[1:].isdigit()]
    raise ValueError(f"{file.path} is not a known product")


class HdfReader(TileReader):
    """Images of lines and samples; a complex pixel is a compound, a third axis or two datasets."""

    def __init__(self, path: str, options: dict):
        file = File(path)
        if "dataset" in options:
            found = [Layer("dataset", tuple(options["dataset"].split(",")), (False, False, False))]
        else:
            found = layers(file)
            if options.get("oriented", "true").lower() != "true":
                found = [replace(x, turn=(False, False, False)) for x in found]
        self.parts = [[file.dataset(name) for name in x.datasets] for x in found]
        self.wanted: dict[int, list[dict]] = {}
        super().__init__(path, [self._image(k, x, parts) for k, (x, parts) in enumerate(zip(found, self.parts, strict=True))], options)

    def _image(self, number: int, layer: Layer, parts: list[Dataset]) -> Image:
        d = parts[0]
        lines, samples = d.shape[:2]
        if d.storage == CHUNKED:
            tile = d.chunk[:2]
        else:
            tile = (max(1, min(lines, blocks.BLOCK // max(1, samples * d.type.itemsize))), samples)
        two = len(parts) == 2 or d.type.names or len(d.shape) == 3 and d.shape[2] == 2
        return Image(number, lines, samples, *tile, "<f4", ("iq",) if two else ("real",), 1, layer.turn)

    def partitions(self):
        for image in self.images:
            low, high = self._stored(image)[0]
            edge = low // image.tile_lines * image.tile_lines
            self.wanted[image.number] = [d.chunks(edge, high) if d.storage == CHUNKED else {} for d in self.parts[image.number]]
        out = super().partitions()
        self.wanted.clear()
        return out

    def place(self, image: Image, i: int, j: int) -> list:
        """For each dataset address, bytes and mask; None for a chunk that isn't stored."""
        out = []
        for d, chunks in zip(self.parts[image.number], self.wanted[image.number], strict=True):
            if d.storage == CHUNKED:
                key = (i * image.tile_lines, j * image.tile_samples) + (0,) * (len(d.shape) - 2)
                out.append(chunks.get(key))
            else:
                width = int(np.prod(d.shape[1:])) * d.type.itemsize
                out.append((d.address + i * image.tile_lines * width, min(image.tile_lines, image.lines - i * image.tile_lines) * width, 0) if d.address != NOWHERE else None)
        return out

    def load(self, image: Image, place: list, first: int, last: int) -> np.ndarray:
        planes = []
        for d, found in zip(self.parts[image.number], place, strict=True):
            shape = (-1, *((d.chunk if d.storage == CHUNKED else d.shape)[1:]))
            if found is None:
                part = np.zeros((last - first + 1, *shape[1:]), d.type)
            elif d.filters:
                part = np.frombuffer(d.unpacked(blocks.read_bytes(self.path, found[0], found[1]), found[2]), d.type).reshape(shape)[first : last + 1]
            else:
                width = int(np.prod(shape[1:])) * d.type.itemsize
                part = np.frombuffer(blocks.read_bytes(self.path, found[0] + first * width, (last - first + 1) * width), d.type).reshape(shape)
            if d.type.names:
                planes += [part[n] for n in d.type.names[:2]]
            elif part.ndim == 3:
                planes += [part[:, :, k] for k in range(part.shape[2])]
            else:
                planes.append(part)
        return np.stack([p.astype(np.float64) for p in planes])


class HdfSource(DataSource):
    """Images of a known product, or with the option ``dataset`` one of any file."""

    @classmethod
    def name(cls):
        return "hdf5raster"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return HdfReader(self.options["path"], self.options)


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HdfSource)


def scalars(files: DataFrame, names: list[str]) -> DataFrame:
    """path, name, text, numbers of small datasets of the files at ``path``, read where the row is."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                file = File(path)
                held = file.links(file.root)
                for name in names:
                    if name.split("/")[0] not in held:
                        continue
                    value = file.value(name)
                    texts = [value] if isinstance(value, str) else value if isinstance(value, list) else None
                    numbers = None if texts else np.atleast_1d(value).astype(float).ravel().tolist()
                    out.append((path, name, texts, numbers))
            yield pd.DataFrame(out, columns=["path", "name", "texts", "numbers"])

    return files.select("path").mapInPandas(read, "path string, name string, texts array<string>, numbers array<double>")
