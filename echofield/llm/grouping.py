"""Best-fit packing by linear grouping.

A document of more than ``SEQUENCE`` tokens is cut into whole sequences behind a first
piece of what is left. Whole pieces are sequences; all others are packed, by a plan that
comes from the histogram of their lengths, at most ``SEQUENCE - 1`` numbers:

* Linear grouping: the lengths over ``SMALL`` are sorted and cut into ``GROUPS`` groups of
  equal cardinality. All of a group count as long as its longest.
* Configurations: with so few sizes, the fewest sequences are a linear programme over the
  ways to fill one. Columns are generated by a knapsack, the shares are rounded down.
* Substitution: the places of a size are taken by the actual documents of its group, in
  order of length. Sequences of a configuration thus fall into a few classes, runs of
  sequences with the same lengths in them.
* Best fit: the documents that rounding left over, and then the small ones, longest first,
  go where the least room is left that holds them. Classes, not sequences, are looked
  through, and split where a run ends.

So a plan has some thousand rows whatever the corpus: each says to which run of sequences a
run of the documents of one length goes. It is sent to the tasks, which know a document's
number among those of its length from counts: no document meets another one. Numbers come
from windows over a length and a salt, of ``WINDOW`` rows on average.

Token ids are those of the tokenizer as it is loaded. Words are looked up in a table that
starts anew at ``CACHE_WORDS``. That is exact, as no token crosses a single space or line
end between other characters; a text with more white space in one place goes to the
tokenizer as a whole. Plain words that are missing get their ids from the same ranks by a faster
library.

Defined results: a null or empty text is the end-of-document id alone. Repeated rows are
packed separately. An empty table gives an empty result. doc_id may be null. Only doc_id
and text are read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEQUENCE = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
CACHE_WORDS = 600_000
#: Characters of the texts that are encoded together; a longer text stands alone.
TEXTS_AT_ONCE = 4 << 20
#: Lengths up to this fill what room is left.
SMALL = 300
GROUPS = 256
#: Documents of one length and salt, on average.
WINDOW = 100_000
#: Bits of a document's number among those of its length.
NUMBER_BITS = 50

#: Characters that both libraries class alike.
PLAIN = re.compile("[!-~À-ÿ]+").fullmatch

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as bytes, four little-endian ones for each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        held = json.loads(self.tokenizer.to_str())
        byte = {letter: bytes([k]) for k, letter in enumerate(_byte_letters())}
        self.special = [x["content"] for x in held["added_tokens"]]
        ranks = {b"".join(byte[c] for c in token): rank for token, rank in held["model"]["vocab"].items() if token not in self.special}
        import public_tokenizers

        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]
        self.words: dict[str, bytes | None] = {}  # behind a space or a line end; None: other white space beside it

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.words
        split = [x.replace("\n", " \n").split(" ") for x in texts]
        new = set().union(*(x[1:] for x in split)).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set().union(*(x[1:] for x in split))
        self._add(new)
        firsts = self._ids([x[0] for x in split])
        out = []
        for text, first, words in zip(texts, firsts, split, strict=True):
            try:
                if words[0][-1:].isspace() or not words[0]:
                    raise TypeError
                del words[0]
                out.append(first + b"".join(map(known.__getitem__, words)))
            except TypeError:
                out.append(self._ids([text])[0])
        return out

    def _add(self, words: set[str]) -> None:
        """Ids of words behind a space, and of those behind a line end, which begin with it."""
        spaced, lined, others = [], [], []
        for w in words:
            bare = w[1:] if w[:1] == "\n" else w
            if not bare or bare[0].isspace() or bare[-1].isspace():
                self.words[w] = None
            elif PLAIN(bare) and not any(s in w for s in self.special):
                (spaced if bare is w else lined).append(w)
            else:
                others.append(w)
        self.words.update(zip(others, self._ids([w if w[0] == "\n" else " " + w for w in others]), strict=True))
        self._add_plain(spaced, " " + "\n ".join(spaced), b"")
        self._add_plain(lined, "".join(lined)[1:], struct.pack("<I", self.line_end))

    def _add_plain(self, words: list[str], lines: str, front: bytes) -> None:
        """A line for each word; words hold no other line ends, and no token crosses one."""
        if words:
            ids = self.ranked.encode_to_numpy(lines).astype("<u4")
            ends = [*np.flatnonzero(ids == self.line_end).tolist(), len(ids)]
            flat, start = ids.tobytes(), 0
            for w, end in zip(words, ends, strict=True):
                self.words[w] = front + flat[4 * start : 4 * end]
                start = end + 1

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(x if x in prints else next(others)) for x in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _cut(vocabulary: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold no cycles, and walking them takes long
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor has a worker for each core
        path = vocabulary or default_vocabulary()
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc_ids, texts in _portions(batch):
                rows = []
                for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for piece in range(-(-n // SEQUENCE)):
                        stop = (n - 1) % SEQUENCE + 1 + piece * SEQUENCE
                        part = ids[4 * start : 4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
                        start = stop
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: len(NAMES) - (not with_ids)], names=NAMES[: len(NAMES) - (not with_ids)])

    return run


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    doc_ids, texts, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        doc_ids.append(doc_id)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held >= TEXTS_AT_ONCE:
            yield doc_ids, texts
            doc_ids, texts, held = [], [], 0
    if doc_ids:
        yield doc_ids, texts


# The plan


class Run(NamedTuple):
    """``count`` documents of a length from number ``start`` on: ``each`` to a sequence, from ``sequence`` on, behind ``offset`` tokens."""

    length: int
    start: int
    count: int
    sequence: int
    each: int
    offset: int


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Groups of equal cardinality: (length, number of documents), longest first in each."""
    out, left = [[]], [counts[n] for n in sorted(counts, reverse=True)]
    total, done = sum(left), 0
    for length, n in zip(sorted(counts, reverse=True), left, strict=True):
        while n:
            room = -(-total * len(out) // groups) - done
            take = min(n, room)
            if take:
                out[-1].append((length, take))
            n, done = n - take, done + take
            if n:
                out.append([])
    return [g for g in out if g]


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """How often to take each size, so that the most value fits: by one document more at a time."""
    rooms = np.arange(room + 1) - sizes[:, None]
    fits = rooms >= 0
    best, choices = np.zeros(room + 1), []
    for _ in range(room // int(sizes.min())):
        worth = np.where(fits, best[rooms] + values[:, None], 0)
        choice = worth.argmax(axis=0)
        choices.append(choice)
        best = worth[choice, np.arange(room + 1)]
    out = np.zeros(len(sizes), np.int64)
    for choice in reversed(choices):
        k = choice[room]
        if fits[k, room]:
            out[k] += 1
            room -= int(sizes[k])
    return out


def configurations(sizes: list[int], needed: list[int], room: int) -> list[tuple[np.ndarray, int]]:
    """(how often each size, number of sequences), at most one for each size.

    The linear programme by column generation, its shares rounded down.
    """
    basis = np.diag([room // s for s in sizes]).astype(float)
    need = np.array(needed, float)
    for _ in range(40 * len(sizes)):
        values = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = knapsack(np.array(sizes), values, room)
        if values @ column <= 1 + 1e-7:
            break
        share, change = np.linalg.solve(basis, np.stack([need, column.astype(float)], 1)).T
        up = change > 1e-9
        leaving = np.flatnonzero(up)[(np.maximum(share[up], 0) / change[up]).argmin()]
        basis[:, leaving] = column
    share = np.linalg.solve(basis, need)
    return [(basis[:, k].round().astype(np.int64), int(n)) for k, n in enumerate(np.floor(share + 1e-9)) if n > 0]


class Plan:
    """Classes of sequences by the room that is left in each, and the runs of documents in them."""

    def __init__(self):
        self.runs: list[Run] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, number)
        self.used: dict[int, int] = defaultdict(int)  # length: documents placed

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], count, sequence, each, offset))
        self.used[length] += count

    def configure(self, slots: list[list[tuple[int, int]]], n: int) -> None:
        """n sequences, each with a document of every slot: runs of (length, number of documents)."""
        first, self.sequences = self.sequences, self.sequences + n
        ends = sorted({int(e) for slot in slots for e in np.cumsum([m for _, m in slot])})
        at = [0] * len(slots)
        left = [slot[0][1] for slot in slots]
        done = 0
        for end in ends:
            m, offset = end - done, 0
            for k, slot in enumerate(slots):
                length = slot[at[k]][0]
                self.place(length, m, first + done, 1, offset)
                offset += length
                left[k] -= m
                if not left[k] and at[k] + 1 < len(slot):
                    at[k] += 1
                    left[k] = slot[at[k]][1]
            self.open[SEQUENCE - offset].append((first + done, m))
            done = end

    def best_fit(self, length: int, count: int) -> None:
        """Documents of one length to the sequences with the least room that holds them."""
        while count:
            room = next((r for r in range(length, SEQUENCE + 1) if self.open.get(r)), None)
            if room is None:
                fresh = -(-count // (SEQUENCE // length))
                self.open[SEQUENCE].append((self.sequences, fresh))
                self.sequences += fresh
                continue
            first, n = self.open[room].pop()
            each = room // length
            full = min(n, count // each)
            if full:
                self.place(length, full * each, first, each, SEQUENCE - room)
                self.open[room - each * length].append((first, full))
                count -= full * each
            if full < n:
                if count:
                    self.place(length, count, first + full, count, SEQUENCE - room)
                    self.open[room - count * length].append((first + full, 1))
                    count, full = 0, full + 1
                if full < n:
                    self.open[room].append((first + full, n - full))


def plan(counts: dict[int, int], groups: int = GROUPS) -> Plan:
    """counts: number of documents of each length below SEQUENCE."""
    out = Plan()
    small = {n: c for n, c in counts.items() if n <= SMALL}
    queues = grouped({n: c for n, c in counts.items() if n > SMALL}, groups)
    if queues:
        sizes = [q[0][0] for q in queues]
        needed = [sum(m for _, m in q) for q in queues]
        merged: dict[int, int] = {}  # equal sizes are one
        for s, m in zip(sizes, needed, strict=True):
            merged[s] = merged.get(s, 0) + m
        kinds = sorted(merged, reverse=True)
        held = {s: [x for q in queues if q[0][0] == s for x in q] for s in kinds}
        for column, n in configurations(kinds, [merged[s] for s in kinds], SEQUENCE):
            slots = [_taken(held[s], n) for s, times in zip(kinds, column.tolist(), strict=True) for _ in range(times)]
            out.configure(slots, n)
        for s in kinds:
            for length, n in held[s]:
                small[length] = small.get(length, 0) + n
    for length in sorted(small, reverse=True):
        out.best_fit(length, small[length])
    return out


def _taken(queue: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The first n documents of a queue, which loses them."""
    out = []
    while n:
        length, m = queue[0]
        take = min(n, m)
        out.append((length, take))
        n -= take
        queue[0] = (length, m - take)
        if take == m:
            del queue[0]
    return out


def _looked_up(runs: list[Run]):
    table = np.array(sorted(runs), np.int64).reshape(-1, len(Run._fields))
    keys = table[:, 0] << NUMBER_BITS | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            at = table[np.searchsorted(keys, length << NUMBER_BITS | number, side="right") - 1]
            past = number - at[:, 1]
            sequence, offset = at[:, 3] + past // at[:, 4], at[:, 5] + past % at[:, 4] * length
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def _packed(docs: DataFrame, vocabulary: str | None, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    schema = SCHEMA + ", ids array<int>" * with_ids
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(vocabulary, with_ids), schema)
    pieces = written(cut.withColumn("row", F.monotonically_increasing_id()), "grouping-pieces")
    whole = pieces.where(F.col("length") == SEQUENCE)
    parts = pieces.where(F.col("length") < SEQUENCE)
    # At most SEQUENCE - 1 rows.
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs = plan(counts).runs
    salts = -(-sum(counts.values()) // WINDOW) or 1
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1
    numbered = salted.withColumn("number", number.cast("long"))
    if salts > 1:
        numbered = numbered.join(firsts, ["length", "salt"]).withColumn("number", F.col("number") + F.col("first"))
    names = cut.columns
    placed = numbered.select(*names, "number").mapInArrow(_looked_up(runs), schema + ", sequence_id long, offset long") if runs else spark.createDataFrame([], schema + ", sequence_id long, offset long")
    alone = whole.select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pieces(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per piece: where it stands in which sequence. Whole pieces have negative sequence numbers."""
    return _packed(docs, vocabulary, False)


def sequences(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per sequence: its tokens without padding, and each document's start in it."""
    placed = _packed(docs, vocabulary, True)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = placed.groupBy("sequence_id").agg(held.alias("held"))
    return joined.select(
        "sequence_id",
        F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"),
        F.transform("held", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("parts"),
    )
