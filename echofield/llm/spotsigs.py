"""SpotSigs fingerprints: signatures that start at common words.

A common word (an anchor) is followed by a chain of content words; anchor and chain are
a signature, and the set of a text's signatures is its fingerprint. Common words hold
running text together, and templates, tables and menus have few, so what a page shares
with its neighbours weighs little.

Anchors are the common words of four languages and, so that junk and other languages
get signatures too, one word in 16 by a hash. A text with words but without any
signature has the hash of its whole word sequence as its only one.

Likeness is the Jaccard coefficient of two sets. Sets are partitioned by length: only
sets whose lengths differ by less than the threshold's ratio can reach it, so
``near_pairs`` compares within a length class and with the next one. There a pair meets
only by signatures among the rarest of both, and is compared in full: it finds every
pair that reaches the threshold.

Defined results: a null text is empty and has the empty fingerprint; two empty
fingerprints have likeness 1. Documents in descending order of doc_id, nulls last,
rows of one doc_id by their text; after the last comes the first. A single document is
its own next one. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import partitions, salted_join, written

# Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there"
    " they this to was we were which who will with you"
    " au aux avec ce cette dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour qui que sa se ses"
    " son sur un une vous"
    " aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es hat ich ihr im ist mit nach nicht"
    " oder sein sich sie sind und von war wie wir zu zum zur"
    " al como con del el ella entre era es esta este la las lo los más mi muy no nos o para pero por que se si sin son su sus"
    " un una uno y ya".split()
)
CHAIN = 2
#: One other word in so many is an anchor.
HASHED = 16
THRESHOLD = 0.8

WORD = re.compile(r"[^\W_]+")


def signatures(text: str) -> frozenset[int]:
    """The fingerprint of a text as a set of 64-bit numbers."""
    words = WORD.findall(text.lower())
    content: list[str] = []
    anchors: list[tuple[str, int]] = []
    for word in words:
        if word in ANCHORS:
            anchors.append((word, len(content)))
        else:
            if crc32(word.encode("utf-8", "replace")) % HASHED == 0:
                anchors.append((word, len(content) + 1))
            content.append(word)
    found = {xxh64_intdigest(" ".join((word, *content[at : at + CHAIN])).encode("utf-8", "replace")) for word, at in anchors if at + CHAIN <= len(content)}
    if not found and words:
        found.add(xxh64_intdigest(" ".join(words).encode("utf-8", "replace")))
    return frozenset(found)


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    if not a and not b:
        return 1.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def rendered(found: frozenset[int]) -> str:
    return " ".join(f"{x:016x}" for x in sorted(found))


def length_class(n: int, threshold: float = THRESHOLD) -> int:
    """Sets of one likeness or more are in one class or in neighbouring ones."""
    return 0 if n == 0 else 1 + int(math.log(n) / -math.log(threshold) + 1e-9)


# Each document with the next one


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the key, by bisection."""
    if not bounds:
        return F.lit(0)
    values = F.array(*map(F.lit, bounds))

    def step(at: Column, k: Column) -> Column:
        further = (at + k).cast("int")
        return F.when((further <= len(bounds)) & (F.element_at(values, F.least(further, F.lit(len(bounds)))) < key), further).otherwise(at)

    powers = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(powers, F.lit(0), step)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, helper, key, doc_id, text: ranges of doc_id with what follows each.

    The last row of a range needs the first one of the range below. That row is sent to
    both; helper marks it where it only follows. Bounds are quantiles of doc_id, one for
    each task, so the list of ranges is as short as that of the tasks.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shares = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else None
    bounds = sorted(set(rows.select(F.percentile_approx("key", shares, F.lit(max(10_000, 10 * n)))).first()[0] or [])) if n > 1 else []
    ranged = rows.withColumn("bucket", _bucket(F.col("key"), bounds).cast("int"))
    tops = [(x["bucket"], x["top"]) for x in ranged.groupBy("bucket").agg(F.max("key").alias("top")).orderBy("bucket").collect()]
    follows = [(tops[k - 1][1], tops[k][0]) for k in range(len(tops))]  # a range's top follows the range above
    spark = docs.sparkSession
    also = F.broadcast(spark.createDataFrame(follows, "key long, above int"))
    sent = ranged.join(also, "key", "left")
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("helper"))
    other = F.struct(F.col("above").alias("to"), F.lit(1).alias("helper"))
    sent = sent.withColumn("at", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, other))))
    dealt = sent.select(F.col("at.to").alias("bucket"), F.col("at.helper").alias("helper"), "key", "doc_id", "text")
    return dealt.repartitionById(max(n, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "helper", F.desc("key"), "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length_class"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
    last = None
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for helper, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
            text = text.as_py() or ""
            if helper and last is None:
                continue  # of several rows of the top doc_id, the first one follows
            own = signatures(text)
            if last is not None:
                before, words, found = last
                half = len(words) // 2
                edited = words[: len(words) - half] + text[:half]
                other = signatures(edited)
                row = (before, len(words), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), rendered(found), rendered(other), likeness(found, other), likeness(found, own), length_class(len(found)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            last = None if helper else (doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, with likenesses."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_class int"
    return with_next(docs).mapInArrow(_compare, schema)


# Pairs


#: Pairs of a signature and a length class from which they are dealt over several tasks.
PAIRS_PER_TASK = 1 << 22


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(sorted(signatures(x.as_py() or "")), np.uint64).view(np.int64) for x in batch.column(1)]
        classes = [length_class(len(x)) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(classes, pa.int32())], names=["doc_id", "signatures", "length_class"])


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b, likeness) of class representatives, and (doc_id, representative).

    Documents with equal sets are a class; its smallest doc_id stands for it, null if it
    has no other. Of two
    sets that reach the threshold, one's rarest signatures are among the other's: a set
    of n needs only its n - ceil(threshold * n) + 1 rarest ones in the index. The index is
    partitioned by length class, and a pair is compared only if its lengths allow the
    threshold.
    """
    rows = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sets, "doc_id long, signatures array<long>, length_class int"), "spot-sets")
    rows = rows.withColumn("set_key", F.xxhash64("signatures"))
    grouped = rows.groupBy("set_key", "signatures", "length_class").agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    # Classes are told apart by numbers of their own, as several may have no doc_id.
    classes = written(grouped.withColumn("class", F.monotonically_increasing_id()), "spot-classes")
    keys = classes.groupBy("set_key").agg(F.sum("copies").alias("size"), F.collect_list(F.struct("signatures", "representative")).alias("sets"))
    member = F.filter("sets", lambda x: x["signatures"] == F.col("signatures"))
    members = salted_join(rows, written(keys, "spot-keys"), ["set_key"], "size", F.xxhash64("doc_id")).select("doc_id", F.get(member, F.lit(0))["representative"].alias("representative"))
    each = classes.select("class", "length_class", F.size("signatures").alias("n"), F.explode("signatures").alias("signature"))
    common = written(each.groupBy("signature").agg(F.count(F.lit(1)).alias("documents")), "spot-common")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("documents", "signature"))
    ranked = salted_join(each, common, ["signature"], "documents", F.xxhash64("class")).withColumn("rank", rank)
    prefix = written(ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("class", "n", "length_class", "signature"), "spot-prefix")
    # A set meets those of its own class and, as the longer one, those of the class below.
    # Classes are cut at the default threshold; a lower one reaches further.
    reach = max(1, math.ceil(math.log(threshold) / math.log(THRESHOLD) - 1e-9))
    right = prefix.withColumn("length_class", F.explode(F.sequence(F.col("length_class") - reach, F.col("length_class"))))
    sizes = prefix.groupBy("signature", "length_class").agg(F.count(F.lit(1)).alias("lefts"))
    sizes = sizes.join(right.groupBy("signature", "length_class").agg(F.count(F.lit(1)).alias("rights")), ["signature", "length_class"])
    # A hot pair of keys is a grid of cells: a left row goes to a line of it, a right one to a column.
    side = F.ceil(F.sqrt(F.col("lefts") * F.col("rights") / PAIRS_PER_TASK)).cast("long")
    sizes = sizes.where("rights > 1").withColumn("side", F.greatest(F.lit(1).cast("long"), side))
    sizes = written(sizes.select("signature", "length_class", "lefts", "rights", "side"), "spot-sizes")
    keys_ = ["signature", "length_class"]
    along, own = F.sequence(F.lit(0).cast("long"), F.col("side") - 1), F.pmod(F.xxhash64("class"), F.col("side"))
    left = salted_join(prefix, sizes.drop("rights"), keys_, "lefts", F.xxhash64("class")).withColumn("line", own).withColumn("column", F.explode(along))
    right = salted_join(right, sizes.drop("lefts"), keys_, "rights", F.xxhash64("class")).withColumn("column", own).withColumn("line", F.explode(along))
    left = left.select(*keys_, "line", "column", F.col("class").alias("p"), F.col("n").alias("n_p"))
    right = right.select(*keys_, "line", "column", F.col("class").alias("q"), F.col("n").alias("n_q"))
    fits = (F.col("n_p") >= F.col("n_q") * threshold) & (F.col("n_q") >= F.col("n_p") * threshold)
    pairs = left.join(right, [*keys_, "line", "column"]).where((F.col("p") != F.col("q")) & fits).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
    sets = lambda x, a: classes.select(F.col("class").alias(x), F.col("representative").alias(a), F.col("signatures").alias(f"s_{a}"))
    pairs = pairs.join(sets("p", "x"), "p").join(sets("q", "y"), "q").withColumnsRenamed({"s_x": "s_a", "s_y": "s_b"})
    common_size = F.size(F.array_intersect("s_a", "s_b"))
    value = common_size / (F.size("s_a") + F.size("s_b") - common_size)
    # The smaller doc_id is a; a missing one is larger than any.
    ordered = F.sort_array(F.array(*(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("id")) for c in ("x", "y"))))
    return pairs.select(F.get(ordered, F.lit(0))["id"].alias("a"), F.get(ordered, F.lit(1))["id"].alias("b"), value.alias("likeness")).where(F.col("likeness") >= threshold), members
