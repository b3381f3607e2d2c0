"""Source divergence audit: how far the sources of each language are from each other.

Tasks count the terms of their documents by group, a (lang, source), in bounded tables.
A language keeps the terms of ``LEAST_DOCS`` of its documents. A group's probability of
a term, in parts of 10^9, is smoothed by two occurrences a term; two groups differ in
a term by the triangular discrimination (p - q)^2 / (p + q), rounded down.

All pairs of groups are compared in two-dimensional tiles. A language's groups are
dealt to blocks of about ``BLOCK`` and its terms to chunks, which stand in slabs of
``SLAB`` successive chunks. A group's counts in a chunk are one packed vector. It is
replicated to the tiles of its block with every block; a task has one tile and slab,
lays the two blocks' vectors of a chunk side by side and adds the chunk's values to the
tile's matrix. What a task holds is bounded by the block, the chunk and the slab. Values
of terms that no group of a tile has are added in one product.

All numbers are integers of 64 bits: counts may reach 2^47 for a term and group, and
9 * 10^15 in all for a language. A chunk has fewer terms the more groups there are.

Defined results: null text, lang and source count as ''. A group without terms is
compared like any other. A language with one source has no pairs; without kept terms all
pairs have value 0. Repeated rows are documents of their own. An empty table gives an
empty result. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_join, written

LEAST_DOCS = 10
#: Ranks of the terms that a group has most in excess.
TERMS = 10
#: Parts that a probability is counted in: ONE * ONE * ONE.
ONE = 1000
#: Groups of a block, on average.
BLOCK = 32
#: Terms of a chunk, on average, and rows (group and term) of it at most where it has FEWEST terms or more.
CHUNK, CHUNK_ROWS, FEWEST = 4096, 1 << 22, 64
#: Successive chunks of a task.
SLAB = 8
#: Entries of a task's table of counts.
HELD = 1 << 19
#: Rows of facts up to which they are broadcast; more are joined by shuffle.
BROADCAST = 1 << 16

#: A position within a chunk takes the low bits of a packed count.
PLACE_BITS = 16

#: Bytes of terms, A-Z lower-cased; others part terms.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (lang, source) not in held:
                held[lang, source] = Counter(), Counter()
                size += 1
            words = text.as_py().translate(_LETTERS).split()
            times, docs = held[lang, source]
            size -= len(times)
            times.update(words)
            docs.update(set(words))
            size += len(times)
            if size > HELD:
                yield _table(held)
                held, size = {}, 0
    if held:
        yield _table(held)


def _table(held: dict) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], []]
    for (lang, source), (times, docs) in held.items():
        # The row without a term says that there is such a group.
        for column, values in zip(
            columns,
            (
                [lang] * (len(times) + 1),
                [source] * (len(times) + 1),
                [b"", *times],
                [0, *times.values()],
                [0, *map(docs.__getitem__, times)],
            ),
            strict=True,
        ):
            column.extend(values)
    arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """A row for each group and kept term, with the language's number; and one with term '' for each group.

    Tables of the tasks meet by language and term, and stay there for the documents'
    number. ``leads`` is true in one row of each language and term.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    met = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    return (
        met.withColumn("lang_docs", F.sum("docs").over(same))
        .withColumn("lang_n", F.sum("n").over(same))
        .withColumn("leads", (F.row_number().over(same.orderBy("source")) == 1) & (F.col("term") != ""))
        .where((F.col("lang_docs") >= LEAST_DOCS) | (F.col("term") == ""))
        .select("lang", "source", "term", "n", "lang_n", "leads")
    )


def _with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """rows with the facts of their key; few facts are broadcast, after a count."""
    if facts.count() <= BROADCAST:
        return rows.join(F.broadcast(facts.drop(size)), keys)
    return salted_join(rows, facts, keys, size, spread).drop(size)


def probability(n: Column, total: Column) -> Column:
    """1 + floor(ONE^3 * n / total) by long division, three digits at a time."""
    out, rest = F.lit(1).cast("long"), n
    for unit in (ONE * ONE, ONE, 1):
        scaled = rest * ONE
        out = out + _div(scaled, total) * unit
        rest = scaled % total
    return out


def _div(a: Column, b: Column) -> Column:
    """Quotient of positive integers."""
    return F.call_function("div", a, b)


def difference(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _probabilities(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.ones_like(n), n
    for unit in (ONE * ONE, ONE, 1):
        digits, rest = np.divmod(rest * ONE, total)
        out = out + digits * unit
    return out


def _tile(rows: pa.Table) -> pa.Table:
    """Sums of one tile over one slab, for both directions of each pair."""
    heads = rows.filter(pc.less(rows["chunk"], 0)).sort_by("source")
    sources, block = heads["source"].to_pylist(), heads["block"].to_numpy()
    totals, terms = heads["total"].to_numpy(), int(heads["terms"][0].as_py())
    lang, low, high, slab = (rows[c][0].as_py() for c in ("lang", "low", "high", "slab"))
    place = {s: k for k, s in enumerate(sources)}
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    absent = _probabilities(np.full(len(sources), 2, np.int64), totals)
    sums = np.zeros((len(left), len(right)), np.int64)
    if slab == 0:  # as if no group had any term; what differs is added below
        p, q = absent[left][:, None], absent[right][None, :]
        sums += terms * ((p - q) ** 2 // (p + q))
    packed = rows.filter(pc.greater_equal(rows["chunk"], 0))
    order = np.argsort(packed["chunk"].to_numpy(), kind="stable")
    chunks = packed["chunk"].to_numpy()[order]
    ends = np.flatnonzero(np.append(chunks[1:] != chunks[:-1], True)) + 1 if len(chunks) else []
    start = 0
    for end in ends:
        part = packed.take(pa.array(order[start:end]))
        start = end
        lists = part["vector"].combine_chunks()
        values = lists.flatten().to_numpy()
        row = np.repeat([place[s] for s in part["source"].to_pylist()], lists.value_lengths().to_numpy())
        columns, column = np.unique(values & ((1 << PLACE_BITS) - 1), return_inverse=True)
        n = np.full((len(sources), len(columns)), 2, np.int64)
        n[row, column] += values >> PLACE_BITS
        chance = _probabilities(n, totals[:, None])
        q, q_absent = chance[right], absent[right]
        for k, g in enumerate(left):
            p = chance[g]
            sums[k] += ((p - q) ** 2 // (p + q)).sum(axis=1) - len(columns) * ((absent[g] - q_absent) ** 2 // (absent[g] + q_absent))
    ones, others = np.nonzero(left[:, None] < right[None, :] if low == high else np.ones(sums.shape, bool))
    a, b = left[ones], right[others]
    names = np.array(sources, object)
    return pa.table(
        {
            "lang": pa.array([lang] * (2 * len(a)), pa.string()),
            "source": pa.array(np.concatenate([names[a], names[b]]), pa.string()),
            "item": pa.array(np.concatenate([names[b], names[a]]), pa.string()),
            "value": pa.array(np.tile(sums[ones, others], 2), pa.int64()),
        }
    )


def audit(docs: DataFrame) -> DataFrame:
    """A row for each pair of a language's sources, and for each group's terms in excess.

    Both pairs and terms are ranked within their group: a window for each group, whose
    size is the number of the language's sources, or of ``TERMS`` in each task.
    """
    rows = written(counts(docs), "divergence-counts")
    of_lang = rows.groupBy("lang").agg(F.sum(F.col("leads").cast("long")).alias("terms"), F.sum("n").alias("lang_total"), F.countDistinct("source").alias("groups"), F.count("*").alias("size"))
    langs = of_lang.withColumn("blocks", F.ceil(F.col("groups") / BLOCK)).withColumn(
        "chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.greatest(F.lit(FEWEST), F.least(F.lit(CHUNK), F.floor(F.lit(CHUNK_ROWS) / F.col("groups"))))))
    )
    of_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("rows"))
    groups = written(
        _with_facts(of_group, langs, ["lang"], "size", F.xxhash64("source"))
        .withColumn("total", F.col("group_n") + 2 * F.col("terms"))
        .withColumn("lang_total", F.col("lang_total") + 2 * F.col("terms"))
        .withColumn("block", F.pmod(F.xxhash64("source"), "blocks")),
        "divergence-groups",
    )
    terms = _with_facts(rows.where("term <> ''"), groups, ["lang", "source"], "rows", F.xxhash64("term"))
    return _pairs(terms, groups).unionByName(_terms(terms))


def _terms(terms: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    more = (
        terms.withColumn("p", probability(F.col("n") + 2, F.col("total")))
        .withColumn("q", probability(F.col("lang_n") + 2, F.col("lang_total")))
        .where(p > q)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(p, q).alias("value"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return more.withColumn("rank", rank).where(F.col("rank") <= TERMS)


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    facts = ["lang", "source", "block", "blocks", "chunks", "total", "terms"]
    placed = terms.withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    # Terms are numbered within their chunk, where the vectors are packed too.
    place = F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    packed = (
        placed.withColumn("packed", F.shiftleft("n", PLACE_BITS).bitwiseOR(place.cast("long")))
        .groupBy(*facts, "chunk")
        .agg(F.collect_list("packed").alias("vector"))
        .withColumn("slab", F.floor(F.col("chunk") / SLAB))
    )
    slabs = F.floor((F.col("chunks") - 1) / SLAB)
    heads = groups.select(*facts, F.lit(-1).cast("long").alias("chunk"), F.array().cast("array<long>").alias("vector"), F.explode(F.sequence(F.lit(0).cast("long"), slabs)).alias("slab"))
    other = F.col("other")
    tiles = (
        heads.unionByName(packed)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("lang", "source", "block", "total", "terms", "chunk", "vector", "slab", F.least("block", other).alias("low"), F.greatest("block", other).alias("high"))
    )
    sums = tiles.groupBy("lang", "low", "high", "slab").applyInArrow(_tile, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
