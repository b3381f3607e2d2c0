"""Removal of long strings that also start in an earlier document.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller
doc_id. Texts are bytes in UTF-8; matches never cross documents and are judged on the
input.

* Count. The hashes of all 16-byte substrings are counted in CELLS cells over all texts.
* Scan. The strings of 50 bytes that start in a text are its windows. Each window has a
  minimiser: of its 16-byte substrings the one in the least frequent cell, and of these
  the one with the smallest hash. So a string that very many documents hold is the
  minimiser only of windows that are all common. Equal windows have equal minimisers.
  Neighbouring windows with one minimiser form a run, whose bytes are sent to the bucket
  of the minimiser. What is sent is combined first: of equal runs within a portion of a
  scan the one with the smallest doc_id goes, and the others are settled at once, so a
  passage that very many documents hold costs one run for each portion.
* Bucket. Minimisers of one document only are left out, and equal runs of different
  portions are combined as before. All windows of the others are put into suffix order. The longest previous factor of a window is its longest match with an
  earlier document: the larger of the common prefixes with the nearest entries before and
  after it in suffix order that belong to earlier documents. A window is removed if that
  reaches 50. A task holds one section of its bucket at a time, about SECTION bytes.
* Cut. Settled byte ranges meet their texts, which are cut and hashed.

Portions and buckets are packed as compressed arrays, so the shuffles move few rows.

Defined results: a null text is empty. Texts under 50 bytes lose nothing. A null doc_id
counts as larger than any other. Rows that share a doc_id never match each other; they
are told apart by their texts. An empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

WINDOW = 50
GRAM = 16
SPAN = WINDOW - GRAM + 1  # substrings of a window that compete for its minimiser
#: Bytes of text whose runs are made together; a longer text stands alone.
PORTION = 4 << 20
#: Bytes of runs that a task packs together.
HELD = 48 << 20
#: Bytes of runs that are put into suffix order together.
SECTION = 6 << 20
#: Bytes of runs for each bucket, and of texts for each task that cuts them; beyond
#: MOST_BUCKETS buckets are larger and have their sections sorted by Spark.
BUCKET = 64 << 20
MOST_BUCKETS = 50_000
#: Bytes of runs for each byte of text, about.
SPREAD = 4
#: Cells in which substrings are counted.
CELL_BITS = 18
CELLS = 1 << CELL_BITS
#: Elements of index arrays that are held at once.
AT_ONCE = 1 << 21
LEVEL = 3
NO_ID = np.iinfo(np.int64).max

A = np.uint64(0x9E3779B97F4A7C15)
B = np.uint64(0xC2B2AE3D27D4EB4F)
C = np.uint64(0xD6E8FEB86659FD93)


# Packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; numbers are stored byte plane by byte plane."""
    parts = [np.array([len(arrays), *(x.dtype.itemsize for x in arrays), *(len(x) for x in arrays)], "<i8").tobytes()]
    parts += [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(kinds)
    sizes = np.frombuffer(raw, "<i8", 2 * n + 1)[1:].reshape(2, n)
    out, at = [], 8 * (2 * n + 1)
    for kind, width, length in zip(kinds, *sizes.tolist(), strict=True):
        planes = np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += width * length
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        held = lengths > 0
        starts, lengths, ends = starts[held], lengths[held], ends[held]
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
        np.cumsum(out, out=out)
    return out


def slices(lengths: np.ndarray, at_once: int = AT_ONCE) -> Iterator[slice]:
    """Consecutive slices whose lengths sum to about at_once."""
    running = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        upto = max(at + 1, int(np.searchsorted(running, running[at] + at_once, "right")) - 1)
        yield slice(at, upto)
        at = upto


# Hashes


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a number."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy()


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each position."""
    each = eights(raw)
    x = each[:-8] * A
    x ^= x >> np.uint64(29)
    x += each[8:] * B
    x ^= x >> np.uint64(32)
    x *= C
    return x


def gram_hash_at(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """As gram_hashes, for some places only."""
    each = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    x = each[places] * A
    x ^= x >> np.uint64(29)
    x += each[places + 8] * B
    x ^= x >> np.uint64(32)
    x *= C
    return x


def ranked(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes that sort by the frequency class of their cell first.

    The class takes the place of the first bits, which the cell gave.
    """
    out = classes[hashes >> np.uint64(64 - CELL_BITS)]
    out |= hashes & np.uint64((1 << 64 - CELL_BITS) - 1)
    return out


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells up to the mean, then one more for each doubling; in the place of a hash's first bits."""
    mean = max(counts.sum() / len(counts), 1.0)
    return np.maximum(np.ceil(np.log2(np.maximum(counts, 1) / mean)), 0).astype(np.uint64) << np.uint64(64 - CELL_BITS)


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """The least of the SPAN hashes from each position on."""
    out, width = hashes, 1
    while 2 * width <= SPAN:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = SPAN - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def span_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span of raw."""
    n = len(raw)
    powers = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, A, np.uint64), out=powers[1:])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    x = (sums[starts + lengths] - sums[starts]) * powers[n - starts]
    x += lengths.astype(np.uint64) * B
    return (x ^ x >> np.uint64(31)) * C


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and the group number of each element in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for key in keys:
            ordered = key[order]
            new[1:] |= ordered[1:] != ordered[:-1]
    return order, np.cumsum(new) - 1


def settled_by_equals(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which spans also stand in a document with a smaller id, byte for byte."""
    out = np.zeros(len(starts), bool)
    if not len(starts):
        return out
    order, group = groups_of(span_hashes(raw, starts, lengths), lengths)
    first = np.full(group[-1] + 1, NO_ID)
    np.minimum.at(first, group, ids[order])
    leader = np.zeros(group[-1] + 1, np.int64)
    leads = np.flatnonzero(ids[order] == first[group])
    leader[group[leads]] = order[leads]
    later = np.flatnonzero(ids[order] > first[group])
    mine, theirs = order[later], leader[group[later]]
    for part in slices(lengths[mine]):
        size = lengths[mine[part]]
        same = raw[ragged(starts[mine[part]], size)] == raw[ragged(starts[theirs[part]], size)]
        bounds = np.concatenate([[0], np.cumsum(size)[:-1]])
        out[mine[part]] = np.logical_and.reduceat(same, bounds)
    return out


# Longest previous factors


def previous_factors(keys: list[np.ndarray], ids: np.ndarray, most: int) -> np.ndarray:
    """The longest common prefix, up to ``most`` bytes, with an earlier document.

    keys: each string as big-endian numbers of 8 bytes, the last padded with zeros. The
    search for the nearest earlier document ends where the common prefix falls below
    ``most``; the result is exact where it reaches ``most``.
    """
    n = len(ids)
    order = np.lexsort([ids, *keys[::-1]])
    sorted_keys, value = [k[order] for k in keys], ids[order]
    common = np.zeros(n, np.int64)  # with the one before in suffix order
    open_ = np.ones(max(n - 1, 0), bool)
    for at, key in enumerate(sorted_keys):
        differ = key[1:] ^ key[:-1]
        # Leading zero bytes of the difference are equal bytes.
        equal = np.zeros(len(differ), np.int64)
        for k in range(8):
            equal += differ < np.uint64(1 << 8 * k)
        found = differ != 0
        width = min(8, most - 8 * at)
        common[1:] += np.where(open_, np.minimum(equal, width), 0)
        open_ &= ~found
    best = np.zeros(n, np.int64)
    for direction in (1, -1):
        values = value[::direction]
        shared = np.zeros(n, np.int64)
        shared[1:] = common[1:] if direction == 1 else common[1:][::-1]
        near = np.arange(n) - 1
        while True:
            on = np.flatnonzero((near >= 0) & (shared >= most))
            on = on[values[near[on]] >= values[on]]
            if not len(on):
                break
            over = near[on]
            shared[on], near[on] = np.minimum(shared[on], shared[over]), near[over]
        shared[near < 0] = 0
        earlier = np.flatnonzero(near >= 0)
        shared[earlier[values[near[earlier]] >= values[earlier]]] = 0
        best = np.maximum(best, shared[::direction])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def window_keys(raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The windows at the given positions, as numbers that sort like their bytes."""
    keys = []
    for at in range(0, WINDOW, 8):
        width = min(8, WINDOW - at)
        key = np.zeros(len(starts), np.uint64)
        for k in range(width):
            key |= raw[starts + at + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        keys.append(key)
    return keys


# The three steps


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for doc_id, mark, text in zip(ids, marks, batch.column(2), strict=True):
        yield NO_ID if doc_id is None else doc_id, mark, (text.as_py() or "").encode("utf-8", "replace")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for row in _texts(batch):
            held.append(row)
            size += len(row[2])
            if size >= PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


def runs(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """raw bytes; for each run its minimiser, text, start in raw, number of windows, start in the text, and the minimiser's place in it."""
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    none = np.zeros(0, np.int64)
    if not (sizes >= WINDOW).any():
        return raw, none.astype(np.uint64), none, none, none, none, none.astype(np.uint8)
    hashes = ranked(gram_hashes(raw), classes)
    least = minimisers(hashes)
    n = len(least)
    ok = np.zeros(n + 1, np.int8)
    long_ = sizes >= WINDOW
    ok[begins[long_]] += 1
    np.add.at(ok, begins[long_] + sizes[long_] - WINDOW + 1, -1)
    valid = np.cumsum(ok[:n], dtype=np.int8) > 0
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[1:] |= ~valid[:-1]
    new[begins[long_]] = True
    starts = np.flatnonzero(new & valid)
    stops = np.flatnonzero(np.concatenate([valid[:-1] & (new[1:] | ~valid[1:]), valid[-1:]])) + 1
    # A minimiser stands SPAN places before the end of its last window at most, so longer
    # runs are of strings that repeat themselves; cut, they become equal runs.
    parts = -(-(stops - starts) // SPAN)
    if (parts > 1).any():
        which = np.repeat(np.arange(len(starts)), parts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, stops = starts[which] + number * SPAN, stops[which]
        stops = np.minimum(stops, starts + SPAN)
    text = np.searchsorted(begins, starts, "right") - 1
    # Texts without bytes share their begin with the next one.
    place = np.empty(len(starts), np.uint8)
    for part in slices(np.full(len(starts), SPAN)):
        place[part] = hashes[starts[part][:, None] + np.arange(SPAN)].argmin(axis=1)
    return raw, least[starts], text, starts, stops - starts, starts - begins[text], place


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with how many 16-byte substrings fall into them; cell -1 has all bytes of the texts."""
    counts, size = np.zeros(CELLS, np.int64), 0
    for held in _portions(batches):
        raw = np.frombuffer(b"".join(x[2] for x in held) + bytes(WINDOW), np.uint8)
        size += len(raw) - WINDOW
        counts += np.bincount((gram_hashes(raw) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS)
    cells = np.flatnonzero(counts)
    if len(cells):
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(counts[cells], size))], names=["cell", "n"])


def text_statistics(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the frequency class of each cell."""
    counts, size = np.zeros(CELLS, np.int64), 0
    # At most CELLS rows of two numbers, whatever the number of documents.
    for x in _rows(docs).mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        if x["cell"] < 0:
            size = x["n"]
        else:
            counts[x["cell"]] = x["n"]
    return size, frequency_classes(counts)


@dataclass(frozen=True)
class Layout:
    """Buckets, sections of a bucket, and tasks that own documents."""

    buckets: int
    sections: int
    owners: int

    @classmethod
    def of(cls, size: int, least: int) -> Layout:
        buckets = min(max(least, size * SPREAD // BUCKET), max(least, MOST_BUCKETS))
        return cls(buckets, max(1, size * SPREAD // (buckets * BUCKET)), min(max(least, size // BUCKET), max(least, MOST_BUCKETS)))


RUN_KINDS = ["<i8", "<i8", "<i4", "u1", "<i4", "u1", "u1"]


def _scan(layout: Layout, shared):
    """shared: broadcast frequency classes."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        place, windows, at, inner = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 8))
        ids, marks = (np.concatenate([x[k] for x in held]) for k in (6, 7))
        doc = np.concatenate([x[1] + base for x, base in zip(held, np.cumsum([0, *(len(x[6]) for x in held[:-1])]), strict=True)])
        starts = np.concatenate([x[4] + base for x, base in zip(held, np.cumsum([0, *(len(x[5]) for x in held[:-1])]), strict=True)])
        raw = np.concatenate([x[5] for x in held])
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(layout.buckets * layout.sections + 1))
        rows = []
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            part = order[bounds[k] : bounds[k + 1]]
            content = raw[ragged(starts[part], windows[part] + WINDOW - 1)]
            used, local = np.unique(doc[part], return_inverse=True)
            packed = pack(ids[used], marks[used], np.diff(local, prepend=0).astype("<i4"), windows[part].astype("u1"), np.diff(at[part], prepend=0).astype("<i4"), inner[part], content)
            rows.append((k % layout.buckets, k // layout.buckets, -1, packed))
        yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for texts in _portions(batches):
            raw, least, text, starts, windows, at, inner = runs([x[2] for x in texts], shared.value)
            if not len(starts):
                continue
            ids, marks = (np.array([x[k] for x in texts], np.int64) for k in (0, 1))
            settled = settled_by_equals(raw, starts, windows + WINDOW - 1, ids[text])
            yield _ranges(ids[text[settled]], marks[text[settled]], at[settled], at[settled] + windows[settled] + WINDOW - 1, layout)
            left = np.flatnonzero(~settled)
            place = (least[left] * C >> np.uint64(8)) % np.uint64(layout.buckets * layout.sections)
            sizes = windows[left] + WINDOW - 1
            held.append((place.astype(np.int64), text[left], windows[left], at[left], np.cumsum(sizes) - sizes, raw[ragged(starts[left], sizes)], ids, marks, inner[left]))
            size += int(sizes.sum())
            if size >= HELD:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in columns[:3]), pa.array(columns[3], pa.binary())], names=["bucket", "section", "owner", "data"])


RANGE_KINDS = ["<i8", "<i8", "<i4", "<i4"]


def _ranges(ids: np.ndarray, marks: np.ndarray, begins: np.ndarray, ends: np.ndarray, layout: Layout) -> pa.RecordBatch:
    """Settled ranges, packed for the tasks that own the documents."""
    owners = layout.owners
    owner = _owner(ids, marks, owners)
    order = np.lexsort([begins, marks, ids, owner])
    bounds = np.searchsorted(owner[order], np.arange(owners + 1))
    rows = []
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        part = order[bounds[k] : bounds[k + 1]]
        rows.append((k % layout.buckets, -1, k, pack(ids[part], marks[part], begins[part].astype("<i4"), ends[part].astype("<i4"))))
    return _batch(rows)


def _owner(ids: np.ndarray, marks: np.ndarray, owners: int) -> np.ndarray:
    mixed = (ids.astype(np.uint64) * A ^ marks.astype(np.uint64)) * C
    return ((mixed >> np.uint64(33)) % np.uint64(owners)).astype(np.int64)


def settle(raw: np.ndarray, ids: np.ndarray, starts: np.ndarray, windows: np.ndarray, inner: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first byte, last byte + 1) of what is removed, bytes counted in the run.

    inner: the place of a run's minimiser within it.
    """
    least = ranked(gram_hash_at(raw, starts + inner), classes)
    # Runs in order of minimiser, cut between minimisers into pieces that fit.
    order = np.argsort(least, kind="stable")
    ordered = least[order]
    size = windows + WINDOW - 1
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
    firsts = np.append(edges, len(order))
    running = np.concatenate([[0], np.cumsum(size[order])])
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    for part in slices(np.diff(running[firsts]), SECTION):
        own = order[firsts[part.start] : firsts[part.stop]]
        own = own[_in_two(least[own], ids[own])]
        if len(own):
            found += _settle_windows(raw, ids, starts, windows, least, own)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _settle_windows(raw: np.ndarray, ids: np.ndarray, starts: np.ndarray, windows: np.ndarray, least: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of some runs whose longest previous factor reaches WINDOW.

    The combining that each portion began ends here: of equal runs the first document's
    stands for all. All windows of what is left, if still of two documents, are put into
    suffix order.
    """
    # The runs move together, so that sums run over little.
    size = windows[own] + WINDOW - 1
    raw = np.concatenate([raw[ragged(starts[own], size)], np.zeros(8, np.uint8)])
    begins = np.cumsum(size) - size
    equal = settled_by_equals(raw, begins, size, ids[own])
    out = [(own[equal], np.zeros(int(equal.sum()), np.int64), size[equal])]
    rest = np.flatnonzero(~equal)
    rest = rest[_in_two(least[own[rest]], ids[own[rest]])]
    places = ragged(begins[rest], windows[own[rest]])
    of = np.repeat(rest, windows[own[rest]])
    gone = previous_factors(window_keys(raw, places), ids[own[of]], WINDOW) >= WINDOW
    places, of = places[gone], of[gone]
    if len(places):
        cut = np.flatnonzero((places[1:] != places[:-1] + 1) | (of[1:] != of[:-1])) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]]) - 1
        run = of[first]
        out.append((own[run], places[first] - begins[run], places[last] - begins[run] + WINDOW))
    return out


def _in_two(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which elements have a key that occurs with two different ids."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order, group = groups_of(keys)
        low, high = np.full(group[-1] + 1, NO_ID), np.full(group[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group, ids[order])
        np.maximum.at(high, group, ids[order])
        out[order] = (low != high)[group]
    return out


def _bucket(layout: Layout, shared):
    """Rows come in order of section; ranges, of section -1, pass on."""

    def settled(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, marks = (np.concatenate([x[k][np.cumsum(x[2])] for x in held]) for k in (0, 1))
        windows = np.concatenate([x[3] for x in held]).astype(np.int64)
        at = np.concatenate([np.cumsum(x[4], dtype=np.int64) for x in held])
        inner = np.concatenate([x[5] for x in held]).astype(np.int64)
        raw = np.concatenate([*(x[6] for x in held), np.zeros(16, np.uint8)])
        held.clear()
        size = windows + WINDOW - 1
        which, begin, end = settle(raw, ids, np.cumsum(size) - size, windows, inner, shared.value)
        if len(which):
            yield _ranges(ids[which], marks[which], at[which] + begin, at[which] + end, layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now = -1
        for batch in batches:
            forward = []
            for bucket, section, owner, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if owner >= 0:
                    forward.append((bucket, section, owner, data))
                    continue
                if section != now and held:
                    yield from settled(held)
                    held = []
                now = section
                held.append(unpack(data, RUN_KINDS))
            if forward:
                yield _batch(forward)
        if held:
            yield from settled(held)

    return run


def _send_texts(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _portions(batches):
            ids, marks = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            owner = _owner(ids, marks, owners)
            rows = []
            for k in np.unique(owner).tolist():
                part = np.flatnonzero(owner == k)
                texts = [held[i][2] for i in part]
                rows.append((0, 0, k, pack(ids[part], marks[part], np.array([len(x) for x in texts], "<i4"), np.frombuffer(b"".join(texts), np.uint8))))
            yield _batch(rows)

    return run


def cut(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed, and of maximal removed runs."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], begins[1:] > ends[:-1]])
    starts, stops = begins[first], ends[np.concatenate([first[1:], [True]])]
    left = [text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True)]
    return b"".join(left), int((stops - starts).sum()), len(starts)


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges come before texts."""
    held: list[list[np.ndarray]] = []
    ready = None
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if kind < 0:
                held.append(unpack(data, RANGE_KINDS))
                continue
            if ready is None:
                ready = _by_document(held)
                held = []
            yield _cut_texts(data, *ready)


def _by_document(held: list[list[np.ndarray]]) -> tuple[dict[tuple[int, int], tuple[int, int]], np.ndarray, np.ndarray]:
    if not held:
        return {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, marks, begins, ends = (np.concatenate(x) for x in zip(*held, strict=True))
    order, group = groups_of(ids, marks)
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    lasts = np.concatenate([firsts[1:], [len(group)]])
    where = {(i, m): (a, b) for i, m, a, b in zip(ids[order[firsts]].tolist(), marks[order[firsts]].tolist(), firsts.tolist(), lasts.tolist(), strict=True)}
    return where, begins[order], ends[order]


def _cut_texts(data: bytes, where: dict, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    ids, marks, sizes, raw = unpack(data, ["<i8", "<i8", "<i4", "u1"])
    raw, at = raw.tobytes(), 0
    out: list[list] = [[], [], [], [], [], []]
    for doc_id, mark, size in zip(ids.tolist(), marks.tolist(), sizes.tolist(), strict=True):
        text = raw[at : at + size]
        at += size
        a, b = where.get((doc_id, mark), (0, 0))
        kept, removed, spans = cut(text, begins[a:b], ends[a:b]) if b > a else (text, 0, 0)
        for column, value in zip(out, (None if doc_id == NO_ID else doc_id, size, removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
            column.append(value)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)


PACKED = "bucket int, section int, owner int, data binary"


def removed_ranges(docs: DataFrame) -> tuple[DataFrame, Layout]:
    """Packed byte ranges to remove, by owner of the documents."""
    size, classes = text_statistics(docs)
    layout = Layout.of(size, partitions(docs.sparkSession))
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # CELLS numbers
    sent = _rows(docs).mapInArrow(_scan(layout, shared), PACKED).repartitionById(layout.buckets, "bucket").sortWithinPartitions("section")
    return written(sent.mapInArrow(_bucket(layout, shared), PACKED).select("owner", "data"), "removed-ranges"), layout


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept; a row per document.

    kept is what is left, as bytes: cuts may part a character.
    """
    ranges, layout = removed_ranges(docs)
    n = layout.owners
    texts = _rows(docs).mapInArrow(_send_texts(n), PACKED).select("owner", F.lit(0).alias("kind"), "data")
    dealt = ranges.select("owner", F.lit(-1).alias("kind"), "data").unionByName(texts).repartitionById(n, "owner").sortWithinPartitions("kind").select("kind", "data")
    return dealt.mapInArrow(_cut_task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
