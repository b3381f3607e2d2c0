"""Exact deduplication over an extendible-hash index kept in shared files.

Texts are equal when they are identical after every run of white space is replaced
by one space. The index has an entry for each key, the first 60 bits of the SHA-256 of
the text.

* Insertion. Documents are counted by key; Spark aggregates within each map task first,
  so a text that holds a third of all rows reaches the shuffle at most once from each.
* Directory. It starts with a bucket for each value of as many key bits as the number of
  entries suggests. While a bucket holds more entries than its capacity, the directory
  doubles, and the overfull buckets are split by the next bit.
* Owner tasks process contiguous ranges of buckets, and so of keys: a document is sent to
  the task with its owner's number. They get the documents whose key
  occurs twice, and with them a copy of each chain's head, the document with the
  smallest doc_id. The bytes of each document are compared with the head's. What
  differs has only the key in common: it goes one place along the chain, to the next
  round, where the smallest doc_id of what is left is the head. So the documents that
  share a head have equal bytes, and the head is what stays.
* A key with many documents is dealt over several tasks, each with its own copy of the
  head.

Texts are shuffled only for keys that occur twice. If their list is over
``BROADCAST_ROWS``, all texts are, once, to meet it. Only DataFrame functions are used.

Defined results: a null text counts as empty; empty texts are copies of each other.
A null doc_id is larger than any other, so it stays only if its group has no other. Of
rows that repeat a doc_id with an equal text one stays, as of any other group. An empty
table gives an empty result. Other columns are never read by ``membership``, and
``deduplicate`` returns them untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import one_spaced, partitions, release, salted_join, written

#: Entries of one bucket before it is split.
BUCKET_CAPACITY = 4096
#: Bits of the key, and those that the directory can use at most.
KEY_BITS, MAX_DEPTH = 60, 40
#: Bits by which the directory can outgrow its first size.
ROOM = 6
#: Rows up to which the directory, or the list of keys that occur twice, is broadcast.
BROADCAST_ROWS = 65_536
#: Documents of a key for each copy of a chain's head.
HEAD_EVERY = 32


def _keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    rows = docs.select(*extra, F.col("doc_id").alias("id"), one_spaced().alias("body")).withColumn("text_sha256", F.sha2("body", 256))
    return rows.withColumn("key", F.conv(F.substring("text_sha256", 1, KEY_BITS // 4), 16, 10).cast("long"))


def _slot(bits: int) -> Column:
    """The first bits of the key."""
    return F.shiftright("key", KEY_BITS - bits)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def directory(entries: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[int, DataFrame]:
    """The number of key bits in use, and (slot, depth, bucket) for each slot of them.

    A slot is a value of the first bits of the key, and its bucket is the first slot with
    the same first depth bits. What is overfull with all bits in use stays one bucket,
    whose chains go on growing.
    """
    depth = max(0, (entries.count() // capacity).bit_length() - 2)
    bits = min(MAX_DEPTH, depth + ROOM)
    slots = entries.groupBy(_slot(bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(depth))
    slots = written(slots, "dedup-directory")
    while depth < bits:
        prefix = F.shiftright("slot", bits - depth)
        full = slots.where(F.col("depth") == depth).groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
        full = written(full.select("prefix", F.lit(1).alias("split")), "dedup-overfull")
        if full.isEmpty():
            break
        depth += 1
        doubled = slots.withColumn("prefix", prefix).join(_small(full), "prefix", "left")
        # A bucket that fitted at an earlier depth has no other one with its prefix.
        doubled = doubled.select("slot", "n", (F.col("depth") + F.coalesce("split", F.lit(0))).alias("depth"))
        before, slots = slots, written(doubled, "dedup-directory")
        release(before)
    own_bits = F.lit(bits) - F.col("depth")
    first = F.call_function("shiftleft", F.call_function("shiftright", F.col("slot"), own_bits), own_bits)
    return bits, slots.select("slot", "depth", first.alias("bucket"))


def index(inserted: DataFrame, capacity: int = BUCKET_CAPACITY) -> tuple[int, DataFrame]:
    """The number of slots, and the index: key, n, bucket; a row for each key."""
    entries = written(inserted.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-entries")
    bits, slots = directory(entries, capacity)
    return 1 << bits, written(entries.withColumn("slot", _slot(bits)).join(_small(slots), "slot").select("key", "n", "bucket"), "dedup-index")


def _chained(rows: DataFrame, slots: int) -> DataFrame:
    """The rows of keys that occur twice with chain, keep_id and keep_tag, by comparing bytes.

    rows: tag, id, key, n, bucket, body and more; tag differs for each row.
    """
    owners = partitions(rows.sparkSession)
    owner = F.floor(F.col("bucket") * owners / slots)
    copies = F.floor(F.col("n") / HEAD_EVERY) + 1
    found, chain = [], 0
    while True:
        first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "tag"))
        # Few heads are broadcast, so that bodies are shuffled to their owners only.
        heads = written(rows.groupBy("key").agg(first.alias("head")).select(F.col("head.tag").alias("tag")), "dedup-heads")
        heads = rows.join(_small(heads), "tag", "left_semi")
        # A head comes first in each group of its key, as every copy of it has role 0.
        copied = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).withColumn("role", F.lit(0))
        dealt = copied.unionByName(rows.withColumn("salt", F.pmod("tag", copies)).withColumn("role", F.lit(1)))
        dealt = dealt.withColumn("task", F.pmod(owner + F.col("salt"), F.lit(owners)).cast("int")).repartitionById(owners, "task")
        along = Window.partitionBy("task", "bucket", "key", "salt").orderBy("role")
        head = F.first(F.struct("id", "tag", "body")).over(along)
        compared = dealt.withColumn("head", head).where("role = 1").withColumn("same", F.col("head.body") == F.col("body"))
        compared = compared.select(*rows.columns, "same", F.lit(chain).alias("chain"), F.col("head.id").alias("keep_id"), F.col("head.tag").alias("keep_tag"))
        compared = written(compared, "dedup-chain")
        found.append(compared.where("same").drop("same", "body"))
        rows = compared.where("not same").select(*rows.columns)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found)
        chain += 1


def _found(docs: DataFrame, capacity: int, *extra: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inserted documents, the index, and the chains of keys that occur twice."""
    inserted = written(_keyed(docs).drop("body"), "dedup-inserted")
    slots, every = index(inserted, capacity)
    twice = every.where("n > 1")
    rows = _joined(_keyed(docs, *extra), twice).withColumn("tag", F.monotonically_increasing_id())
    return inserted, every, _chained(written(rows, "dedup-twice"), slots)


def _joined(rows: DataFrame, twice: DataFrame) -> DataFrame:
    if twice.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(twice), "key")
    return salted_join(rows, twice, ["key"], "n", F.xxhash64("id"))


def membership(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket, chain; a row per document."""
    inserted, every, chains = _found(docs, capacity)
    single = salted_join(inserted, every, ["key"], "n", F.xxhash64("id")).where("n = 1")
    single = single.select("id", "text_sha256", "bucket", F.lit(0).alias("chain"), F.col("id").alias("keep_id"), F.lit(True).alias("kept"), F.col("n").alias("group_size"))
    sizes = chains.groupBy("key", "chain").agg(F.count(F.lit(1)).alias("group_size"))
    copies = salted_join(chains, sizes, ["key", "chain"], "group_size", F.col("tag"))
    copies = copies.select("id", "text_sha256", "bucket", "chain", "keep_id", (F.col("tag") == F.col("keep_tag")).alias("kept"), "group_size")
    every_row = single.unionByName(copies)
    return every_row.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256", "bucket", "chain")


def deduplicate(docs: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    _, every, chains = _found(docs, capacity, F.struct("*").alias("row"))
    twice = every.where("n > 1").select("key", "n")
    rows = _keyed(docs, F.struct("*").alias("row"))
    if twice.count() <= BROADCAST_ROWS:
        single = rows.join(F.broadcast(twice), "key", "left_anti")
    else:
        single = salted_join(rows, every.select("key", "n"), ["key"], "n", F.xxhash64("id")).where("n = 1")
    kept = chains.where(F.col("tag") == F.col("keep_tag"))
    return single.select("row").unionByName(kept.select("row")).select("row.*")
