"""Mixing sources to target weights by a low-discrepancy schedule.

Sources, ordered by code point with null last, get weights that repeat 5, 2, 1. The
mix holds 150 % of all words. A source gives at most twice its words; what it can't
give is shared among the others by weight.

* The schedule has one slot for each block of words; a source has as many as its
  target needs, and its last one is clipped to the target. Slot j of n is the place
  (j + 1) * step mod n, mapped through the sources' cumulative slots. step has no factor
  in common with n, so each place occurs once, and is near n / golden ratio, so any run
  of slots has nearly the target shares: the mix can be cut anywhere. As step has an
  inverse modulo n, each source lays out its own places and computes their slots.
* Slots are ranked within their source.
* The documents of a source, shuffled by a hash and read twice, are a stream of words
  that is cut into blocks of equal length. Rank k takes block k. So each reading of a
  document gets the slot of its first block, and the mix is in order of slots.

Ranks and running sums are made in two levels (chunks, then rows within a chunk), so
no window holds a whole source. Only DataFrame functions are used.

Defined results: a null text has size 0. A document of size 0 has taken 0 and no slots,
and ``mixed`` passes it through once. A source's taken adds up to its target, rounded.
Repeated rows are separate documents. Documents with
equal hashes are ordered by doc_id and size, so ties are between equal rows only. If
all sizes are 0, targets are 0. An empty table gives an empty result. The table of
sources (one row each, numbers and a name) is the only one that is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: The schedule has at least so many slots, unless blocks get shorter than LEAST_BLOCK.
LEAST_SLOTS = 65_536
LEAST_BLOCK, MOST_BLOCK = 16, 1024
#: Documents of a source are dealt to so many chunks for running sums.
CHUNKS = 4096
SLOT_CHUNK = 4096
GOLDEN = (math.sqrt(5) - 1) / 2
#: Steps next to n / golden ratio that are compared.
STEPS = 64
#: Places are multiplied in two digits of this base, so that products fit into a long.
DIGIT = 1 << 20
#: The hash that shuffles a source's documents: so many hexadecimal digits of MD5.
HEX = 15


#: Marks a document's source in keys, so that null is a value like others.
def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count().alias("size")).withColumn("key", _source_key())


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, below: the words that each source gives.

    With sources in order of their limit per weight, those that reach their limit come
    first; the level of the others follows from what is left at that point.
    """
    each = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_code = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_code) - 1) % len(WEIGHTS) + 1).cast("double")
    each = each.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * PASSES).cast("double"))
    by_limit = everything.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    each = (
        each.withColumn("total", F.sum("source_size").over(everything) * F.lit(SHARE))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0)))
        .withColumn("own_level", F.col("left") / F.col("weights"))
    )
    first = F.min(F.when(F.col("own_level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("own_level")))).over(everything)
    level = first.getField("own_level")
    each = each.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit"))))
    below = F.sum("target").over(by_code.rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("below", F.coalesce(below, F.lit(0.0))).select("source", "key", "source_size", "target", "below")


def block_words(words: float) -> int:
    """Words of a block: the schedule keeps LEAST_SLOTS slots where blocks allow it."""
    return int(max(LEAST_BLOCK, min(MOST_BLOCK, words // LEAST_SLOTS)))


def golden_step(n: int) -> int:
    """The step of a schedule of n slots: coprime to n and near n / golden ratio.

    Of several the one whose continued fraction over n has the smallest largest term,
    which bounds how uneven a run of slots can be.
    """
    near = round(n * GOLDEN)
    best = (n + 1, 0, 1)
    for k in range(-STEPS, STEPS + 1):
        step = near + k
        if 0 < step < n and math.gcd(step, n) == 1:
            a, b, largest = n, step, 0
            while b:
                largest = max(largest, a // b)
                a, b = b, a % b
            best = min(best, (largest, abs(k), step))
    return best[2]


def goal(target: Column) -> Column:
    """Whole words of a target."""
    return F.floor(target + 0.5)


def slot_count(sources: DataFrame, block: int) -> int:
    return int(sources.agg(F.coalesce(F.sum(F.ceil(goal(F.col("target")) / block)), F.lit(0))).first()[0])


def times_modulo(place: Column, factor: int, n: int) -> Column:
    """place * factor mod n without a product over 2**63, for n up to 2**42."""
    high, low = F.floor(place / F.lit(DIGIT)), F.pmod(place, F.lit(DIGIT))
    return F.pmod(high * F.lit(factor * DIGIT % n) + F.pmod(low * F.lit(factor % n), F.lit(n)), F.lit(n))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(key, slot, rank): which source fills each slot, ranked within the source.

    The places of a source are consecutive, so it makes them itself, SLOT_CHUNK at a
    time, and finds each one's slot with the inverse of the step.
    """
    upto = F.sum("slots").over(Window.partitionBy(F.lit(0)).orderBy("below", "key"))
    each = sources.select("key", "below", F.ceil(goal(F.col("target")) / block).cast("long").alias("slots")).where("slots > 0")
    each = each.withColumn("first", upto - F.col("slots"))
    n = slot_count(sources, block)
    if n == 0:
        return each.select("key", F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("rank")).where("false")
    parts = each.select("key", "first", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_CHUNK))).alias("part"))
    ends = F.least(F.col("slots"), (F.col("part") + 1) * SLOT_CHUNK) - 1
    # Parts are dealt evenly, whatever source they belong to.
    parts = parts.repartition(partitions(sources.sparkSession), "key", "part")
    places = parts.select("key", F.explode(F.sequence(F.col("first") + F.col("part") * SLOT_CHUNK, F.col("first") + ends)).alias("place"))
    slot = F.pmod(times_modulo(F.col("place"), pow(golden_step(n), -1, n) if n > 1 else 0, n) - 1, F.lit(n))
    slots = places.select("key", slot.alias("slot")).withColumn("chunk", F.floor(F.col("slot") / SLOT_CHUNK))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("key", "chunk").orderBy("slot")
    ranked = slots.withColumn("place", F.row_number().over(within) - 1).join(counts.drop("n").hint("merge"), ["key", "chunk"])
    return ranked.select("key", "slot", (F.col("before") + F.col("place")).alias("rank"))


def shuffle_hash() -> Column:
    """A number of 60 bits by which a source's documents are shuffled."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("long")


def streams(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document that has words, with the place where it starts in its source's stream."""
    bits = 4 * HEX - (CHUNKS.bit_length() - 1)
    hashed = sized.where(F.col("size") > 0).withColumn("hash", shuffle_hash()).withColumn("chunk", F.shiftright("hash", bits).cast("int"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = hashed.groupBy("key", "chunk").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    chunks = chunks.join(sources.select("key", "source_size", "target"), "key")
    within = Window.partitionBy("key", "chunk").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("place", F.coalesce(F.sum("size").over(within), F.lit(0))).join(chunks, ["key", "chunk"])
    return placed.select("doc_id", "key", "size", "source_size", "target", (F.col("before") + F.col("place")).alias("start"))


def blocks(placed: DataFrame, block: int) -> DataFrame:
    """The pieces of documents that fall into each block of their source's stream.

    What lies behind the target counts no words.
    """
    each = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1)))).withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    each = each.withColumn("rank", F.explode(F.sequence(first, last)))
    words = F.least(F.col("begin") + F.col("size"), (F.col("rank") + 1) * block, goal(F.col("target"))) - F.greatest("begin", F.col("rank") * block)
    return each.withColumn("words", F.greatest(words, F.lit(0)))


def readings(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each document's readings and the number of slots.

    doc_id, key, size, source_size, target, start, pass, taken, slot; a document without
    words has one row, with pass -1.
    """
    sized = written(sizes(docs), "mix-sizes")
    sources = written(targets(sized), "mix-sources")
    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    block = block_words(words)
    # Slots are so regular that their shuffled size tells little of them; they aren't broadcast.
    pieces = blocks(streams(sized, sources), block).join(schedule(sources, block).hint("merge"), ["key", "rank"], "left")
    own = ["doc_id", "key", "size", "source_size", "target", "start"]
    used = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)
    first = F.min_by(F.when(F.col("words") > 0, F.col("slot")), "rank")
    taken = pieces.groupBy(*own, "pass").agg(F.coalesce(F.sum(used), F.lit(0)).alias("taken"), first.alias("slot"))
    empty = sized.where(F.col("size") == 0).join(sources.select("key", "source_size", "target"), "key")
    none = empty.select("doc_id", "key", "size", "source_size", "target", F.lit(0).cast("long").alias("start"), F.lit(-1).alias("pass"), F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("slot"))
    return taken.select(*own, "pass", "taken", "slot").unionByName(none), slot_count(sources, block)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slot, second_slot; a row per document.

    slot and second_slot are where its first and second reading begin in the schedule;
    null where nothing is taken.
    """
    source = F.when(F.col("key") == "-", F.lit(None)).otherwise(F.expr("substring(key, 2)"))
    each, _ = readings(docs)
    both = ["doc_id", "key", "size", "source_size", "target", "start"]
    # Documents without words have one row each and none of the readings to add up.
    full = each.where("pass >= 0").groupBy(*both).agg(F.sum("taken").alias("taken"), F.max(F.when(F.col("pass") == 0, F.col("slot"))).alias("slot"), F.max(F.when(F.col("pass") == 1, F.col("slot"))).alias("second_slot"))
    none = each.where("pass < 0").select(*both, "taken", "slot", F.col("slot").alias("second_slot"))
    return full.unionByName(none).select("doc_id", source.alias("source"), "size", "source_size", "target", "taken", "slot", "second_slot")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs in order of the schedule, once for each reading that takes at least half of the words.

    Documents without words stay once. Rows that repeat doc_id, source and size share
    one verdict, the larger. Rows are dealt to partitions by ranges of slots, so a
    partition is a run of the schedule and holds nearly the target shares.
    """
    n = partitions(docs.sparkSession)
    each, slots = readings(docs)
    decided = each.where(F.col("taken") * 2 >= F.col("size")).groupBy("doc_id", "key", "size", "pass").agg(F.min("slot").alias("slot"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _source_key().alias("source_key"), word_count().alias("words"))
    same = rows["id"].eqNullSafe(decided["doc_id"]) & (rows["source_key"] == decided["key"]) & (rows["words"] == decided["size"])
    part = F.coalesce(F.floor(F.col("slot") * n / max(slots, 1)), F.pmod(F.xxhash64("id"), F.lit(n))).cast("int")
    placed = rows.join(decided, same).select("row", "slot", part.alias("part"))
    return placed.repartitionById(n, "part").sortWithinPartitions("slot").select("row.*")
