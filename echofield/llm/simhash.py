"""SimHash fingerprints and their links by the generalised pigeonhole principle.

A fingerprint has 64 bits: the majority of the XXH64 hashes of the text's four-word
shingles. Two fingerprints link at four or fewer differing bits.

* Documents with one fingerprint are one node, made by a grouping that Spark
  aggregates before the shuffle, so copies never meet as pairs.
* The bits are grouped into parts, correlated bits together. With thresholds t_i of at
  least -1 whose (t_i + 1) sum to 5, two fingerprints within four bits differ in at
  most t_i bits of some part i, else they would differ in 5 or more.
* Each fingerprint gets its own thresholds: dynamic programming over the parts finds
  those with the fewest probes and expected candidates. The expectation comes from
  counts, over all fingerprints, of the values of each part (of each half of it, if a part
  is over 16 bits). A part whose value is frequent gets a low threshold, down to -1, and
  others a higher one. The program is run with two to five parts, and the number that
  costs least over all fingerprints is taken.
* Every fingerprint is stored under its value of each part, and probes the values
  within its thresholds. Keys with one fingerprint go. Candidates that share a key are
  compared in full. Where a key has much to compare, its probes are dealt over several
  tasks, each with a copy of what is stored.
* What leaves a task is a spanning forest of the links that it found, never all pairs.
  Forests are joined by alternating large-star and small-star steps, each written to
  the shared folder. Nodes with very many links are dealt over several tasks.

Defined results: a text without words, null included, has fingerprint zero and links
like any other. With one to three words the whole sequence is the only shingle. A null
doc_id is never the smallest unless its whole component is null. Repeated rows are
separate rows of one node. An empty table gives an empty result. Only doc_id and text
are read, and ``representatives`` returns other columns untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import partitions, release, salted_join, written

WORDS = 4
SEED = 42
BITS = 64
DISTANCE = 4
#: Pairs that a task compares at once.
PAIRS_AT_ONCE = 1 << 21
#: Rows of whole keys that a task holds at once, if no key has more.
ROWS_AT_ONCE = 1 << 20
#: Pairs of a key from which its probes are dealt over several tasks.
PAIRS_PER_TASK = 1 << 24
#: Rows of the probe table for each task.
PROBES_PER_TASK = 1_000_000
#: Cost of comparing a candidate, in probes.
CANDIDATE_COST = 0.02
#: Bits of a part's value that are counted together.
COUNTED_BITS = 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    begins, ends = starts[: len(words) - WORDS + 1].tolist(), (starts[WORDS:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends, strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed numbers of 64 bits."""
    return pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# Parts and thresholds


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, frequency of each bit, and the bits' correlations."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(_unsigned(batch.column(0)))
            both += bits.T @ bits
            n += len(bits)
        cells = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(both.ravel().astype(np.int64)), pa.array(np.full(len(cells), n))], names=["cell", "n", "total"])

    rows = nodes.select("fp").mapInArrow(count, "cell long, n long, total long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cell").collect()
    if not rows:
        return 0, np.full(BITS, 0.5), np.zeros((BITS, BITS))
    total = rows[0]["total"]
    both = np.array([x["n"] for x in rows], float).reshape(BITS, BITS) / max(total, 1)
    each = both.diagonal().copy()
    spread = np.sqrt(np.maximum(each * (1 - each), 1e-9))
    return total, each, (both - np.outer(each, each)) / np.outer(spread, spread)


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Parts of nearly equal size; each takes the bits most correlated with its own."""
    strength = np.abs(correlation - np.eye(BITS))
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part = [max(sorted(left), key=lambda b: strength[b, sorted(left)].sum())]
        left.discard(part[0])
        while len(part) < size:
            part.append(max(sorted(left), key=lambda b: strength[b, part].sum()))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def halves(part: list[int]) -> list[list[int]]:
    """The bits of a part that are counted together."""
    return [part] if len(part) <= COUNTED_BITS else [part[0::2], part[1::2]]


def value_of(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each value, as a small number."""
    out = np.zeros(len(values), np.int64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def value_counts(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each group of bits, how many fingerprints have each value of them."""
    firsts = np.cumsum([0, *(1 << len(g) for g in groups)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(firsts[-1], np.int64)
        for batch in batches:
            values = _unsigned(batch.column(0))
            for first, group in zip(firsts, groups, strict=False):
                total += np.bincount(first + value_of(values, group), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    out = np.zeros(firsts[-1], np.int64)
    # At most 2 ** COUNTED_BITS numbers for each group, whatever the number of rows.
    for x in nodes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[x["cell"]] = x["n"]
    return [out[a:b] for a, b in zip(firsts, firsts[1:], strict=False)]


def around(counts: np.ndarray) -> np.ndarray:
    """(3, values): how many fingerprints are at 0, 1 and 2 bits from each value."""
    size = len(counts).bit_length() - 1
    places = np.arange(len(counts))
    one = sum((counts[places ^ 1 << b] for b in range(size)), np.zeros_like(counts))
    two = sum((counts[places ^ (1 << a | 1 << b)] for a, b in combinations(range(size), 2)), np.zeros_like(counts))
    return np.stack([counts, one, two]).astype(np.float64)


@dataclass
class Partition:
    """Parts of the bits with what is known about their values."""

    parts: list[list[int]]
    tables: list[list[np.ndarray]]  # for each part and half: around()
    n: int

    def candidates(self, values: np.ndarray, part: int) -> np.ndarray:
        """(3, len(values)): expected fingerprints within 0, 1 and 2 bits in a part."""
        found = [t[:, value_of(values, h)] for h, t in zip(halves(self.parts[part]), self.tables[part], strict=True)]
        if len(found) == 1:
            return np.cumsum(found[0], axis=0)
        (a0, a1, a2), (b0, b1, b2) = found
        return np.cumsum([a0 * b0, a1 * b0 + a0 * b1, a2 * b0 + a1 * b1 + a0 * b2], axis=0) / max(self.n, 1)

    def thresholds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each fingerprint and part a threshold from -1 to 2, and the cost of all.

        The sum of threshold + 1 over the parts is DISTANCE + 1.
        """
        need, most = DISTANCE + 1, 3
        best = np.full((len(values), need + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for k, part in enumerate(self.parts):
            near = self.candidates(values, k)
            probes = np.cumsum([comb(len(part), t) for t in range(most)])
            cost = [np.zeros(len(values)), *(probes[:, None] + CANDIDATE_COST * near)]
            now = np.full_like(best, np.inf)
            pick = np.zeros(best.shape, np.int8)
            for given in range(most + 1):
                for total in range(given, need + 1):
                    with_this = best[:, total - given] + cost[given]
                    better = with_this < now[:, total]
                    now[better, total] = with_this[better]
                    pick[better, total] = given
            best = now
            chosen.append(pick)
        out = np.zeros((len(values), len(self.parts)), np.int8)
        total = np.full(len(values), need)
        for k in range(len(self.parts) - 1, -1, -1):
            given = chosen[k][np.arange(len(values)), total]
            out[:, k] = given - 1
            total = total - given
        return out, best[:, need]


def partitioned(nodes: DataFrame, parts: int | None = None) -> Partition:
    """The partition, of those with two to five parts, whose thresholds cost least."""
    n, _, correlation = bit_statistics(nodes)
    options = [grouped_bits(correlation, m) for m in ([parts] if parts else range(2, DISTANCE + 2))]
    counted = iter(value_counts(nodes, [h for option in options for part in option for h in halves(part)]))
    found = [Partition(option, [[around(next(counted)) for _ in halves(part)] for part in option], n) for option in options]
    if len(found) == 1 or not n:
        return found[-1]
    shared = nodes.sparkSession.sparkContext.broadcast(found)  # some megabytes, whatever the number of rows

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value))
        for batch in batches:
            values = _unsigned(batch.column(0))
            total += [x.thresholds(values)[1].sum() for x in shared.value]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["option", "cost"])

    rows = nodes.select("fp").mapInArrow(costs, "option long, cost double").groupBy("option").agg(F.sum("cost").alias("cost")).collect()
    return found[min(rows, key=lambda x: (x["cost"], x["option"]))["option"]]


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)


# Probing and comparing

STORED, ASKING = 1, 2


def _probe(shared) -> Callable:
    """shared: a broadcast Partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = shared.value
        masks = [sum(1 << b for b in part) for part in partition.parts]
        flips = [[[0], [1 << b for b in part], [1 << a | 1 << b for a, b in combinations(part, 2)]] for part in partition.parts]
        for batch in batches:
            values = _unsigned(batch.column(0))
            limit, _ = partition.thresholds(values)
            for k, mask in enumerate(masks):
                # Bits outside the part tell parts apart. Where two parts' keys are equal
                # by chance, the comparison in full decides.
                base = values & np.uint64(mask)
                tag = np.uint64(k * 0x9E3779B97F4A7C15 % 2**64 & ~mask & 2**64 - 1)
                asks = limit[:, k] >= 0
                yield _rows(base | tag, values, np.where(asks, STORED | ASKING, STORED))
                for radius in (1, 2):
                    far = limit[:, k] >= radius
                    if far.any():
                        around_ = np.array(flips[k][radius], np.uint64)
                        keys = (base[far][:, None] ^ around_).ravel() | tag
                        yield _rows(keys, np.repeat(values[far], len(around_)), np.full(len(keys), ASKING))

    return run


def _rows(keys: np.ndarray, values: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values.view(np.int64)), pa.array(kinds.astype(np.int8))], names=["key", "fp", "kind"])


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; every node's parent is its set's smallest."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def compare(keys: np.ndarray, values: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value it is linked to here) for what candidates share a key."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    stored = (kinds & STORED) > 0
    order = np.lexsort((~stored, keys))
    keys, values, stored, asking = keys[order], values[order], stored[order], (kinds[order] & ASKING) > 0
    if not len(keys):
        return none
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    held = np.add.reduceat(stored.astype(np.int64), starts)
    first, many = np.repeat(starts, sizes), np.repeat(held, sizes)
    asks = np.flatnonzero(asking & (many > 0) & (np.repeat(sizes, sizes) > 1))
    if not len(asks):
        return none
    nodes, local = np.unique(values, return_inverse=True)
    parent = np.arange(len(nodes))
    running = np.concatenate([[0], np.cumsum(many[asks])])
    done = 0
    while done < len(asks):
        upto = max(done + 1, int(np.searchsorted(running, running[done] + PAIRS_AT_ONCE, "right")) - 1)
        part = asks[done:upto]
        count = many[part]
        left = np.repeat(part, count)
        right = np.arange(len(left)) - np.repeat(running[done:upto] - running[done], count) + np.repeat(first[part], count)
        near = np.bitwise_count(values[left] ^ values[right]) <= DISTANCE
        a, b = local[left[near]], local[right[near]]
        parent = union(parent, a, b)
        done = upto
    linked = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[linked], nodes[parent[linked]]


def _compare_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares whole keys, some at a time; rows come in order of key."""
    kinds = (np.int64, np.int64, np.int8)
    held, rows = [[np.zeros(0, k)] for k in kinds], 0

    def flush(upto: int | None) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in held]
        upto = len(columns[0]) if upto is None else int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
        for k, column in enumerate(columns):
            held[k] = [column[upto:]]
        keys, values, marks = (x[:upto] for x in columns)
        a, b = compare(keys.view(np.uint64), values.view(np.uint64), marks)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        for k in range(3):
            held[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            yield from flush(0)
            rows = len(held[0][0])
    yield from flush(None)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of hot keys over the cells of a grid: what asks to a line of it, what is stored to a column.

    Each pair meets in one cell. n rows of a key are copied ``side`` times each, n / 2**12
    of them, where dealing out one side alone would copy n / 2**12 squared times.
    """
    asking, stored = F.col("kind").bitwiseAND(ASKING) > 0, F.col("kind").bitwiseAND(STORED) > 0
    i, j, side = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("side")), F.pmod(F.xxhash64("fp", F.lit(2)), F.col("side")), F.col("side")
    along = F.sequence(F.lit(0).cast("long"), side - 1)
    none = F.array().cast("array<long>")
    asks = F.when(asking, F.transform(along, lambda k: F.col("i") * side + k)).otherwise(none)
    holds = F.when(stored, F.transform(along, lambda k: k * side + F.col("j"))).otherwise(none)
    cells = F.when(side == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(asks, holds))
    each = rows.withColumn("i", i).withColumn("j", j).withColumn("cell", F.explode(cells))
    line, column = F.floor(F.col("cell") / side) == F.col("i"), F.col("cell") % side == F.col("j")
    kind = F.when(asking & line, F.lit(ASKING)).otherwise(0) + F.when(stored & column, F.lit(STORED)).otherwise(0)
    # A cell of a key is a key of its own.
    return each.select(F.xxhash64("key", "cell").alias("key"), "fp", kind.cast("tinyint").alias("kind"))


def links(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b): linked fingerprints; their forests hold every link between texts."""
    shared = nodes.sparkSession.sparkContext.broadcast(partitioned(nodes, parts))
    probes = written(nodes.select("fp").mapInArrow(_probe(shared), "key long, fp long, kind tinyint"), "probes")
    asking, stored = F.col("kind").bitwiseAND(ASKING) > 0, F.col("kind").bitwiseAND(STORED) > 0
    keys = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(asking.cast("long")).alias("asks"), F.sum(stored.cast("long")).alias("holds"))
    side = F.ceil(F.sqrt(F.col("asks") * F.col("holds") / PAIRS_PER_TASK)).cast("long")
    keys = written(keys.where("n > 1 and asks > 0 and holds > 0").withColumn("side", F.greatest(F.lit(1).cast("long"), side)), "probe-keys")
    dealt = _dealt(salted_join(probes, keys.select("key", "n", "side"), ["key"], "n", F.xxhash64("fp")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(partitions(nodes.sparkSession), total // PROBES_PER_TASK)
    return dealt.repartition(int(tasks), "key").sortWithinPartitions("key").mapInArrow(_compare_task, "a long, b long").distinct()


def _with_least(edges: DataFrame) -> DataFrame:
    """a, b, m: edges with the smallest neighbour of a; nodes with many are dealt out."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return salted_join(edges, written(least, "least"), ["a"], "n", F.xxhash64("b")).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    before = None
    while True:
        # Large star: larger neighbours go to the smallest one.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        # Small star: smaller neighbours and the node itself go to the smallest one.
        large = written(large, "links")
        small = _with_least(large).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        small = written(small.unionByName(own).where("a != b").distinct(), "links")
        release(now)
        release(large)
        now = small
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def link(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id; a row per document."""
    rows = written(docs.select("doc_id", fingerprints(F.col("text").cast("string")).alias("fp")), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    found = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    placed = salted_join(placed, written(smallest, "roots"), ["root"], "nodes", F.xxhash64("fp"))
    placed = written(placed.select("fp", "n", "component_id"), "components")
    out = salted_join(rows, placed, ["fp"], "n", F.xxhash64("doc_id"))
    return out.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component's smallest, with all columns."""
    keep = link(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    return rows.join(keep, rows["id"].eqNullSafe(keep["id"]), "left_semi").select("row.*")
