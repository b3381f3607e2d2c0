"""Packing by power-of-two decomposition.

A document of n tokens is split into pieces of 2048 tokens, as many as fit, and then
into one piece for each binary digit of what is left, longest first. Each piece is a
sequence of its own, so no sequence crosses documents and none is padded. Pieces of
equal length share a bucket, the binary logarithm of the length. Each task fills the
buckets' batches as pieces come: a batch holds ``BATCH`` tokens in sequences of one
length, and only the last one of a task and bucket can have fewer.

Token ids are those of the tokenizer as it is loaded, so strings of its special tokens
get their special ids. They come from a table of words. That is exact as the tokenizer
never joins anything across white space, nor letters with marks. Words that are missing are added:
plain ones by the tokenizer's own merges applied to thousands of words at a time, others
by the tokenizer. A table that would grow over ``CACHE_WORDS`` is started anew.

Documents are read once and nothing is shuffled: ids leave the workers as checksums
(``pieces``) or as they are (``sequences``).

Defined results: a null or empty text is the end-of-document id alone, one piece of
length 1. Repeated rows are packed separately. An empty table gives an empty result.
doc_id may be null. Only doc_id and text are read.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
END_ID = 1
#: Tokens of a batch of sequences of one length.
BATCH = 1 << 16
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 600_000
#: Words of one length whose merges are made together.
MERGED_AT_ONCE = 20_000
#: Characters of the texts that are encoded together; a longer text stands alone.
TEXTS_AT_ONCE = 4 << 20

#: Words that the tokenizer lower-cases letter by letter and parts from one mark at
#: their end: letters of Latin-1, which composition leaves alone.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
PLAIN_LENGTH = 24

_encoders: dict[str, Encoder] = {}


class WordMerges:
    """The tokenizer's merges, applied to many words at a time.

    Words are rows of symbol ids. Each round merges, in every word that still can, the
    first of its pairs of lowest rank.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        keys = np.array([ids[x] << 16 | ids[y] for x, y in pairs], np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([ids[x + y] for x, y in pairs], np.int32)
        letters = _byte_letters()
        self.inner = np.array([ids[letters[x]] for x in range(256)], np.int32)
        self.last = np.array([ids[letters[x] + end] for x in range(256)], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], self.NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """words: all of one length."""
        n, size = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, size)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        left = np.full(n, size)
        out = np.zeros((n, size), np.int32)
        rows, places = np.arange(n), np.arange(size)
        ranks = np.full((n, size), self.NONE, np.int32)
        ranks[:, : size - 1] = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            going = least != self.NONE
            if not going.all():
                done = ~going
                out[rows[done]] = ids[done]
                rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = self.made[least]
            left[rows] -= 1
            source = np.minimum(places + (places > at[:, None]), size - 1)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, np.minimum(places + (places >= at[:, None]), size - 1), 1)
            ranks[:, -1] = self.NONE
            for side in (at - 1, at):
                held = (side >= 0) & (side + 1 < left[rows])
                ranks[each[held], side[held]] = self.ranks(ids[each[held], side[held]], ids[each[held], side[held] + 1])
            # What lies behind the last symbol has no rank.
            ends = left[rows] - 1
            ranks[each, ends] = self.NONE
        flat = out.astype("<u4").tobytes()
        return [flat[4 * size * k : 4 * (size * k + m)] for k, m in enumerate(left.tolist())]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(x if x in prints else next(others)) for x in range(256)]


class Encoder:
    """Ids of texts as bytes, four little-endian ones for each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = WordMerges(self.tokenizer)
        self.words: dict[str, bytes] = {}  # as they stand in texts
        self.marks = self._ids([".", ","])

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.words
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        new = set().union(*split).difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set().union(*split)
        known.update(self._new(new))
        return [b"".join([known[w] for w in words]) for words in split]

    def _new(self, words: set[str]) -> dict[str, bytes]:
        rest: list[str] = []
        stems: dict[int, list[bytes]] = defaultdict(list)
        plain: dict[int, list[str]] = defaultdict(list)
        for w in words:
            stem = w[:-1] if w[-1:] in (".", ",") else w
            if len(stem) <= PLAIN_LENGTH and (stem.isascii() and stem.isalpha() or PLAIN(stem)):
                raw = stem.lower().encode()
                stems[len(raw)].append(raw)
                plain[len(raw)].append(w)
            else:
                rest.append(w)
        out = self._ids(rest)
        marks = self.marks
        for size, same in stems.items():
            for k in range(0, len(same), MERGED_AT_ONCE):
                ids = self.merges.encode(same[k : k + MERGED_AT_ONCE])
                out.update((w, x + marks[w[-1]] if w[-1] in marks else x) for w, x in zip(plain[size][k : k + MERGED_AT_ONCE], ids, strict=True))
        return out

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: struct.pack(f"<{len(x)}I", *x.ids) for w, x in zip(words, encoded, strict=True)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def lengths(n: int, most: int = SEQUENCE) -> list[int]:
    """The pieces of n tokens: whole sequences, then the binary digits of the rest."""
    full, rest = divmod(n, most)
    return [most] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(vocabulary: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables hold no cycles, and walking them takes long
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor has a worker for each core
        path = vocabulary or default_vocabulary()
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end = END_ID.to_bytes(4, "little")
        made: dict[int, int] = defaultdict(int)  # pieces of each length in this task
        for batch in batches:
            for doc_ids, texts in _portions(batch):
                out: list[list] = [[], [], [], [], [], [], [], []]
                for doc_id, ids in zip(doc_ids, encoder.encode(texts), strict=True):
                    ids += end
                    total, start = len(ids) // 4, 0
                    for n in lengths(total):
                        piece = ids[4 * start : 4 * (start + n)]
                        row = (doc_id, start, n, zlib.crc32(piece), total, n.bit_length() - 1, made[n] * n // BATCH, piece if with_ids else None)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        made[n] += 1
                        start += n
                yield _batch(out, with_ids)

    return run


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


def _batch(out: list[list], with_ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in out[:7]]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "batch"]
    if with_ids:
        offsets = pa.array([0, *_running(len(x) // 4 for x in out[7])], pa.int32())
        values = pa.Array.from_buffers(pa.int32(), sum(len(x) for x in out[7]) // 4, [None, pa.py_buffer(b"".join(out[7]))])
        arrays.append(pa.ListArray.from_arrays(offsets, values))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _running(lengths: Iterable[int]) -> Iterator[int]:
    total = 0
    for n in lengths:
        total += n
        yield total


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long, batch long"


def _pieces(docs: DataFrame, vocabulary: str | None, with_ids: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = rows.mapInArrow(_pack(vocabulary, with_ids), SCHEMA + ", ids array<int>" * with_ids)
    # Batches are numbered within the task, whose number goes in front.
    batch = F.spark_partition_id().cast("long") * F.lit(1 << 32) + F.col("batch")
    return packed.withColumn("batch", batch).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def pieces(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per piece; its sequence holds this piece alone, so offset is 0.

    A sequence's length is the piece's, a power of two. bucket and batch together name
    the batch of equal lengths that it is drawn with.
    """
    return _pieces(docs, vocabulary, False)


def sequences(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces with their ids: the training sequences."""
    return _pieces(docs, vocabulary, True)


def write_buckets(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write the sequences, a folder for each bucket."""
    sequences(docs, vocabulary).write.partitionBy("bucket").parquet(path)
