"""Rasters stored as two-dimensional tiles.

A file holds one or more images; an image is a grid of equal tiles, the last ones of a
row or column being padded or cut. A format says where a tile's samples lie. Bounds on r
and c become ranges of the grid, so what lies outside is neither planned nor read; of a
plain tile only the lines that are asked for are read. A partition is a run of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import blocks
from .blocks import ELEMENTS

SCHEMA = "image int, band int, r long, c long, re double, im double"


@dataclass(frozen=True)
class Place:
    """Where a tile's samples lie: the first one of each plane, and steps in bytes."""

    planes: tuple[int, ...]
    line: int
    sample: int


@dataclass(frozen=True)
class Image:
    """An image of stored lines and samples; ``turn`` leads from them to r and c.

    ``pixels`` makes (re, im) of an array by plane, line and sample: a name of PIXELS
    and its parameters. ``bands`` pixels stand in each place.
    """

    number: int
    lines: int
    samples: int
    tile_lines: int
    tile_samples: int
    element: str
    pixels: tuple = ("iq",)
    bands: int = 1
    turn: tuple[bool, bool, bool] = (False, False, False)  # lines and samples backwards; exchanged

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.lines // self.tile_lines), -(-self.samples // self.tile_samples)


# Pixels of planes


def _iq(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return planes[0::2], planes[1::2]


def _real(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return planes, np.zeros(planes.shape)


def _table(planes: np.ndarray, tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Look-up tables, a band for each; numbers beyond one are its last entry."""
    found = np.stack([np.array(t, np.float64)[np.minimum(planes[0].astype(np.int64), len(t) - 1)] for t in tables])
    return found, np.zeros(found.shape)


def _half(planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper halves of two floats."""
    values = (planes.astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    return values[0::2], values[1::2]


def _polar(planes: np.ndarray, magnitude: int, turn: float, remap: str, scale: float, knee: float) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and phase, a full turn being ``turn``; the magnitude may be remapped."""
    m, phase = planes[magnitude::2].astype(np.float64), planes[1 - magnitude :: 2] * (2 * np.pi / turn)
    if remap == "LINM":
        m = m / scale
    elif remap == "LINP":
        m = np.sqrt(m / scale)
    elif remap in ("LOGM", "LOGP"):  # eight bits of what had sixteen
        m = 10 ** (m * np.log10(32767.0) / 255)
    elif remap == "LLM":
        m = np.where(m > knee, 10 ** (m * np.log10(knee) / knee), m) / scale
    elif remap != "NS":
        raise ValueError(f"magnitudes remapped by {remap} are not supported")
    return m * np.cos(phase), m * np.sin(phase)


PIXELS = {"iq": _iq, "real": _real, "table": _table, "half": _half, "polar": _polar}


@dataclass
class Run(InputPartition):
    """Tiles of an image, with their places, and the bounds of what is wanted in stored lines and samples."""

    image: Image
    tiles: list[tuple[int, int, object]]
    lines: tuple[int, int]
    samples: tuple[int, int]


@dataclass
class Bounds:
    low: dict = field(default_factory=lambda: {"r": 0, "c": 0, "image": 0})
    high: dict = field(default_factory=lambda: {"r": 1 << 62, "c": 1 << 62, "image": 1 << 62})

    def take(self, f) -> bool:
        """Whether a filter is a bound."""
        name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
        if len(name) != 1 or name[0] not in self.low or not isinstance(value, int):
            return False
        n = name[0]
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.low[n] = max(self.low[n], value + isinstance(f, GreaterThan))
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.high[n] = min(self.high[n], value - isinstance(f, LessThan))
        return isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))


class TileReader(DataSourceReader):
    """Formats give images and place(image, i, j); also load(image, place, lines), if tiles aren't plain."""

    def __init__(self, path: str, images: list[Image], options: dict):
        self.path, self.images, self.bounds = path, images, Bounds()
        self.stride = {"r": int(options.get("rowstride", 1)), "c": int(options.get("colstride", 1))}

    def place(self, image: Image, i: int, j: int):
        """None for a tile that isn't stored."""
        raise NotImplementedError

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def _stored(self, image: Image) -> tuple[tuple[int, int], tuple[int, int]]:
        """Bounds in stored lines and samples."""
        names = ("c", "r") if image.turn[2] else ("r", "c")
        out = []
        for name, size, back in zip(names, (image.lines, image.samples), image.turn, strict=False):
            low, high = max(0, self.bounds.low[name]), min(size - 1, self.bounds.high[name])
            out.append((size - 1 - high, size - 1 - low) if back else (low, high))
        return out[0], out[1]

    def partitions(self):
        out = []
        for image in self.images:
            if not self.bounds.low["image"] <= image.number <= self.bounds.high["image"]:
                continue
            lines, samples = self._stored(image)
            if lines[0] > lines[1] or samples[0] > samples[1]:
                continue
            tiles = [
                (i, j, place)
                for i in range(lines[0] // image.tile_lines, lines[1] // image.tile_lines + 1)
                for j in range(samples[0] // image.tile_samples, samples[1] // image.tile_samples + 1)
                if (place := self.place(image, i, j)) is not None
            ]
            size = image.tile_lines * image.tile_samples * np.dtype(image.element).itemsize * image.bands * 2
            step = max(1, blocks.BLOCK // size)
            if size > blocks.BLOCK and self.plain:  # a large tile is runs of its lines
                part = max(1, blocks.BLOCK // (size // image.tile_lines))
                for tile in tiles:
                    top = tile[0] * image.tile_lines
                    low, high = max(top, lines[0]), min(top + image.tile_lines - 1, lines[1])
                    out += [Run(image, [tile], (k, min(k + part - 1, high)), samples) for k in range(low, high + 1, part)]
                continue
            out += [Run(image, tiles[k : k + step], lines, samples) for k in range(0, len(tiles), step)]
        return out

    @property
    def plain(self) -> bool:
        """Whether some lines of a tile can be read without the others."""
        return type(self).load is TileReader.load

    def load(self, image: Image, place: Place, first: int, last: int) -> np.ndarray:
        """Planes of the tile's lines first to last."""
        item = np.dtype(image.element).itemsize
        width = (image.tile_samples - 1) * place.sample + item
        shape, steps = (last - first + 1, image.tile_samples), (place.line, place.sample)
        starts = [p + first * place.line for p in place.planes]
        length = (last - first) * place.line + width
        if max(starts) - min(starts) < place.line:  # planes within a line are read together
            raw = blocks.read_bytes(self.path, min(starts), length + max(starts) - min(starts))
            parts = [(raw, s - min(starts)) for s in starts]
        else:
            parts = [(blocks.read_bytes(self.path, s, length), 0) for s in starts]
        return np.stack([np.ndarray(shape, image.element, raw, at, steps) for raw, at in parts])

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        image = partition.image
        make, extra = PIXELS[image.pixels[0]], image.pixels[1:]
        back_r, back_c, exchanged = image.turn
        for i, j, place in partition.tiles:
            top, left = i * image.tile_lines, j * image.tile_samples
            low, high = max(top, partition.lines[0]), min(top + image.tile_lines - 1, partition.lines[1], image.lines - 1)
            begin, end = max(left, partition.samples[0]), min(left + image.tile_samples - 1, partition.samples[1], image.samples - 1)
            c = np.arange(begin, end + 1)
            c = image.samples - 1 - c if back_c else c
            steps = (self.stride["c"], self.stride["r"]) if exchanged else (self.stride["r"], self.stride["c"])
            chosen = np.flatnonzero(c % steps[1] == 0)
            for first_line, last_line in blocks.pieces(low, high, image.tile_samples * image.bands) if self.plain else [(low, high)]:
                r = np.arange(first_line, last_line + 1)
                r = image.lines - 1 - r if back_r else r
                kept = np.flatnonzero(r % steps[0] == 0)
                if not len(kept) or not len(chosen):
                    continue
                planes = self.load(image, place, first_line - top, last_line - top)[:, :, begin - left : end - left + 1]
                re, im = make(np.ascontiguousarray(planes[:, kept][:, :, chosen].astype(planes.dtype.newbyteorder("="))), *extra)
                n = len(kept) * len(chosen)
                places = [np.repeat(r[kept], len(chosen)), np.tile(c[chosen], len(kept))]
                first, second = places[::-1] if exchanged else places
                for band in range(image.bands):
                    columns = [np.full(n, image.number, np.int32), np.full(n, band, np.int32), first, second, re[band].ravel().astype(np.float64), im[band].ravel().astype(np.float64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["image", "band", "r", "c", "re", "im"])


class BlockedReader(TileReader):
    def __init__(self, path: str, image: Image, offset: int, options: dict):
        super().__init__(path, [image], options)
        self.offset = offset

    def place(self, image: Image, i: int, j: int) -> Place:
        return block_place(image, self.offset, i, j, "pixel")


def block_place(image: Image, offset: int, i: int, j: int, interleave: str, planes: int | None = None) -> Place:
    """Blocks follow each other, line of blocks by line of blocks; all are of full size."""
    item = np.dtype(image.element).itemsize
    n = planes or image.bands * (1 if image.pixels[0] in ("real", "table") else 2)
    area = image.tile_lines * image.tile_samples * item
    across, down = image.grid[1], image.grid[0]
    number = i * across + j
    if interleave == "pixel":
        return Place(tuple(offset + number * area * n + k * item for k in range(n)), image.tile_samples * item * n, item * n)
    if interleave == "line":
        return Place(tuple(offset + number * area * n + k * image.tile_samples * item for k in range(n)), image.tile_samples * item * n, item)
    if interleave == "block":
        return Place(tuple(offset + (number * n + k) * area for k in range(n)), image.tile_samples * item, item)
    return Place(tuple(offset + (k * across * down + number) * area for k in range(n)), image.tile_samples * item, item)


class BlockedSource(DataSource):
    """A raster in blocks, whose geometry the options give.

    rows, cols, blockrows, blockcols, element, complex, bands, offset, bigendian; the
    samples of a place stand together.
    """

    @classmethod
    def name(cls):
        return "blockedraster"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        o = self.options
        order = ">" if o.get("bigendian", "false").lower() == "true" else "<"
        kind = ("iq",) if o.get("complex", "true").lower() == "true" else ("real",)
        image = Image(0, int(o["rows"]), int(o["cols"]), int(o["blockrows"]), int(o["blockcols"]), order + ELEMENTS[o.get("element", "float32")], kind, int(o.get("bands", 1)))
        return BlockedReader(o["path"], image, int(o.get("offset", 0)), o)


def turned(image: Image, turn: tuple[bool, bool, bool]) -> Image:
    return replace(image, turn=turn)
