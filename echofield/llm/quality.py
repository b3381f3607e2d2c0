"""Quality classifier with supervised subword embeddings.

A document's features are its words, its pairs of neighbouring words, and the byte
3-grams and 4-grams within words (the space on either side counts as part of a word),
hashed to buckets. A pair's hash is made from the difference of its words' hashes, so
all words that repeat the one before share a bucket. Each bucket has a
vector; a document is the mean of its features' vectors, and a softmax layer gives the
two labels' probabilities. Vectors and layer are trained together by stochastic
gradient descent in numpy.

Training takes at most ``MAX_ROWS`` labelled documents, those with the smallest hashes
of doc_id, whatever their length. Tasks turn whole texts into counts of buckets, so the
driver gets compact bags, never texts. Scoring reads whole texts. As the layer is linear
in the mean, each bucket needs one number then, and scoring is a table look-up.

Defined results: a null text is empty; an empty text has no features, and its score is
the softmax of the layer's bias. Rows whose doc_id is null are held out. Without any
usable label the score is 0.5. Repeated rows get equal scores; several labels for a
document are as many examples. Only text decides a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 18
DIMENSIONS = 8
EPOCHS = 8
RATE = 12.0
#: Labelled documents that training takes at most.
MAX_ROWS = 6000
THRESHOLD = 0.3
FOLDS = 5
#: Bytes of text whose features are made together.
AT_ONCE = 2 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(29)) * MIX >> np.uint64(64 - 18)).astype(np.int32)


class Words:
    """Texts laid end to end in one array of bytes, a space before and after each."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self.space = SPACES[self.raw]
        lengths = np.array([len(x) + 1 for x in texts], np.int64)
        self.ends = np.cumsum(lengths)  # a text's last space
        self.begins = self.ends - lengths

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions where words start, and those behind their ends."""
        edges = np.flatnonzero(self.space[1:] != self.space[:-1]) + 1
        return edges[::2], edges[1::2]

    def word_hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        n = len(self.raw)
        powers = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, BASE, np.uint64), out=powers[1:])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        # Divided down by the power of the start, so that a word's hash is the same everywhere.
        np.multiply.accumulate(np.full(n, INVERSE, np.uint64), out=powers[1:])
        return (sums[stops] - sums[starts]) * powers[starts]

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(position, bucket) of each kind of feature, in order of position."""
        starts, stops = self.words()
        hashes = self.word_hashes(starts, stops)
        out = [(starts, _buckets(hashes))]
        pairs = np.flatnonzero(self.text_of(starts[1:]) == self.text_of(starts[:-1]))
        out.append((starts[pairs + 1], _buckets((hashes[pairs + 1] - hashes[pairs]) * BASE + np.uint64(2))))
        raw = self.raw.astype(np.uint32)
        letter = ~self.space
        three = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        held = np.flatnonzero(letter[1:-1])
        out.append((held, _buckets(three[held].astype(np.uint64) * BASE + np.uint64(3))))
        held = np.flatnonzero(letter[1:-2] & letter[2:-1])
        out.append((held, _buckets((three[held] | raw[held + 3] << 24).astype(np.uint64) * BASE + np.uint64(4))))
        return out


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "replace") for x in texts]


def portions(texts: list[bytes], at_once: int = AT_ONCE) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= at_once:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Model:
    """What scoring needs: the difference of the two labels' logits for each bucket."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for part in portions(texts):
            laid = Words(part)
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for at, buckets in laid.features():
                running = np.concatenate([[0.0], np.cumsum(self.table[buckets], dtype=np.float64)])
                first, last = np.searchsorted(at, laid.begins), np.searchsorted(at, laid.ends)
                total += running[last] - running[first]
                count += last - first
            out.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias))))
        return np.concatenate(out)


def small(numbers: np.ndarray) -> np.ndarray:
    """The numbers in the narrowest unsigned type that holds them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


@dataclass
class Bag:
    """How often each bucket occurs in a document; most of it takes three bytes a bucket."""

    gaps: np.ndarray  # between the buckets, in order
    counts: np.ndarray

    @classmethod
    def of(cls, found: np.ndarray) -> Bag:
        each, counts = np.unique(found, return_counts=True)
        return cls(small(np.diff(each, prepend=0)), small(counts))

    def buckets(self) -> np.ndarray:
        return np.cumsum(self.gaps, dtype=np.int64)

    def shares(self) -> np.ndarray:
        return (self.counts / max(int(self.counts.sum()), 1)).astype(np.float32)


def bags(texts: list[bytes]) -> Iterator[Bag]:
    for part in portions(texts):
        laid = Words(part)
        kinds = [(np.searchsorted(at, laid.begins), np.searchsorted(at, laid.ends), b) for at, b in laid.features()]
        for k in range(len(part)):
            yield Bag.of(np.concatenate([b[first[k] : last[k]] for first, last, b in kinds]))


def fit(examples: list[Bag], labels: list[int], seed: int = 7) -> Model:
    """Train on the bags of the given examples."""
    if not examples or len(set(labels)) < 2:
        only = {0: -20.0, 1: 20.0}.get(labels[0], 0.0) if labels else 0.0
        return Model(np.zeros(BUCKETS, np.float32), only)
    order = np.random.default_rng(seed)
    vectors = order.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    rate_of_one = float(np.mean(labels))
    bias = np.log(np.array([1 - rate_of_one, rate_of_one], np.float32))
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            rate = RATE * (1 - step / steps)
            step += 1
            each, weights = examples[k].buckets(), examples[k].shares()
            hidden = weights @ vectors[each]
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[k]] -= 1
            back = layer @ error
            layer -= rate / 10 * np.outer(hidden, error)
            bias -= rate / 1000 * error
            vectors[each] -= np.outer(rate * weights, back)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(True))


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "quality", "tie", "n", "gaps", "counts"]
    for batch in batches:
        kept = [batch.column(k).to_pylist() for k in range(3)]
        for k, bag in enumerate(bags(_encoded(batch.column(3).to_pylist()))):
            arrays = [pa.array([x], t) for x, t in zip((*(x[k] for x in kept), len(bag.gaps)), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([bag.gaps.tobytes()]), pa.array([bag.counts.tobytes()])], names=names)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, np.uint8)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold; see the module's bound."""
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    # At most max_rows pairs of numbers are broadcast.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "quality", F.xxhash64("text").alias("tie"), "text").mapInArrow(_bag_rows, "doc_id long, quality int, tie long, n long, gaps binary, counts binary")
    rows = written(rows, "quality-bags")
    # Documents that repeat a doc_id can be more than the labels; the bound is on them too.
    keys = rows.select("doc_id", "quality", "tie").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "tie").limit(max_rows).collect()
    places: dict[tuple, list[int]] = {}
    for k, x in enumerate(keys):
        places.setdefault(tuple(x), []).append(k)
    found: dict[int, tuple[Bag, int]] = {}
    # A partition at a time, so the driver holds the bags once.
    for x in rows.toLocalIterator():
        at = places.get((x["doc_id"], x["quality"], x["tie"]))
        if at:
            found[at.pop()] = Bag(_numbers(x["gaps"], x["n"]), _numbers(x["counts"], x["n"])), x["quality"]
    examples, targets = [found[k][0] for k in sorted(found)], [found[k][1] for k in sorted(found)]
    return fit(examples, targets)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column that gives its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(_encoded(batch.tolist())), dtype="float64")

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; a row per document."""
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, train(docs, labels))(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    return docs.where(scorer(docs, train(docs, labels))(F.col("text")) >= THRESHOLD)
