from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from echofield.llm import exact_dedup, simhash, suffix_dedup


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_membership_against_brute_force(odd, odd_rows):
    groups = defaultdict(list)
    for row in odd_rows:
        groups[normal(row[1])].append(row[0])
    got = Counter((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.membership(odd, capacity=2).collect())
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            want[i, keep, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_buckets_split_until_they_fit(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = exact_dedup.membership(docs, capacity=8)
    sizes = [x["count"] for x in rows.groupBy("bucket").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 8 and len(sizes) > 60
    assert {x.chain for x in rows.collect()} == {0}


def test_chains_tell_texts_with_one_key_apart(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEY_BITS", 4)  # so that most texts collide
    monkeypatch.setattr(exact_dedup, "MAX_DEPTH", 4)
    monkeypatch.setattr(exact_dedup, "HEAD_EVERY", 2)
    test_exact_membership_against_brute_force(odd, odd_rows)
    rows = exact_dedup.membership(odd, capacity=2).collect()
    assert len({x.chain for x in rows}) > 1
    assert len({(x.bucket, x.text_sha256[:1], x.chain) for x in rows}) == len({x.text_sha256 for x in rows})
    kept = exact_dedup.deduplicate(odd).collect()
    assert sorted(normal(x.text) for x in kept) == sorted({normal(x[1]) for x in odd_rows})


def test_lists_that_are_too_large_to_broadcast(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    test_exact_membership_against_brute_force(odd, odd_rows)
    assert exact_dedup.deduplicate(odd).count() == len({normal(x[1]) for x in odd_rows})


def test_deduplicate_keeps_columns_and_one_of_each(odd):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    texts = [normal(x.text) for x in kept.collect()]
    assert len(texts) == len(set(texts))
    assert set(texts) == {normal(x.text) for x in odd.collect()}


def test_empty_tables(none):
    assert exact_dedup.membership(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert simhash.link(none).count() == 0
    assert suffix_dedup.deduplicate(none).count() == 0


def test_components_against_brute_force(odd, odd_rows):
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.fingerprint, x.component_id) for x in simhash.link(odd).collect())
    prints = [simhash.fingerprint(x[1]) for x in odd_rows]
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, row in enumerate(odd_rows):
        least[root(k)].append(row[0])
    want = sorted((row[0] is not None, row[0] or 0, f"{prints[k]:016x}", min(i for i in least[root(k)] if i is not None)) for k, row in enumerate(odd_rows))
    assert got == want


def test_links_of_dense_fingerprints_with_every_number_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    values = []
    for c in centres:
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            values.append(int(c) ^ sum(1 << int(b) for b in flips))
    values = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    want = simhash.union(np.arange(len(values)), *np.nonzero(near))
    nodes = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long")
    place = {int(x): k for k, x in enumerate(values.view(np.int64))}
    for parts, pairs in ((2, 1 << 24), (3, 64), (4, 1 << 24), (5, 64), (None, 256)):
        monkeypatch.setattr(simhash, "PAIRS_PER_TASK", pairs)
        found = simhash.links(nodes, parts).collect()
        got = simhash.union(np.arange(len(values)), np.array([place[x.a] for x in found]), np.array([place[x.b] for x in found]))
        assert (got == want).all(), parts


def brute_partition(values, m):
    parts = simhash.grouped_bits(np.eye(64), m)
    counts = [[simhash.around(np.bincount(simhash.value_of(values, h), minlength=1 << len(h))) for h in simhash.halves(part)] for part in parts]
    return simhash.Partition(parts, counts, len(values))


def test_thresholds_sum_up():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 50, dtype=np.uint64)
    for m in (2, 3, 4, 5):
        found = brute_partition(values, m)
        assert sorted(b for p in found.parts for b in p) == list(range(64))
        assert ((found.thresholds(values)[0] + 1).sum(axis=1) == 5).all()


def test_expected_candidates_are_counts():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 2**63, 4000, dtype=np.uint64) & np.uint64(0x0F0F_3333_FFFF_00FF)
    found = brute_partition(values, 5)
    for k, part in enumerate(found.parts):
        mask = np.uint64(sum(1 << b for b in part))
        apart = np.bitwise_count((values[:7, None] ^ values[None, :]) & mask)
        assert (found.candidates(values[:7], k) == [(apart <= t).sum(axis=1) for t in range(3)]).all()


def test_thresholds_are_unequal_where_bits_are_clustered(spark):
    """Bits that go together make a part of little use, so it gets -1 and another one more."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 2**63, 20_000, dtype=np.uint64) & np.uint64(0xFFFF_FFFF_FFFF_0000)
    values |= rng.integers(0, 2, 20_000).astype(np.uint64) * np.uint64(0xFFFF)
    values[:300] ^= np.uint64(1) << rng.integers(0, 16, 300).astype(np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in np.unique(values).view(np.int64)], "fp long")
    found = simhash.partitioned(nodes)
    limits, _ = found.thresholds(np.unique(values))
    assert (limits.min(axis=1) == -1).mean() > 0.9 and (limits.max(axis=1) >= 1).mean() > 0.9


def test_chains_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {x.node: x.root for x in simhash.components(edges).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100


def test_representatives_keep_columns(odd):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    ids = {x.doc_id for x in kept.collect()}
    assert 0 in ids and not ids & {1, 2, 11}


def brute_cut(rows):
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        for k in range(len(text) - 49):
            first.setdefault(text[k : k + 50], i)
    for i, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - 49):
            if first[text[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        yield None if i == suffix_dedup.NO_ID else i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_cut_texts_against_brute_force(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PORTION", 2000)
    rows = [(suffix_dedup.NO_ID if x[0] is None else x[0], (x[1] or "").encode()) for x in odd_rows]
    want = sorted(brute_cut(rows), key=str)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicate(odd).collect()), key=str)
    assert got == want


def test_previous_factors():
    texts = [b"abcdefgh" * 2, b"abcdefgh" * 2, b"abcdefgX" * 2]
    keys = [np.array([int.from_bytes(t[k : k + 8], "big") for t in texts], np.uint64) for k in (0, 8)]
    assert suffix_dedup.previous_factors(keys, np.array([1, 2, 3]), 16).tolist() == [0, 16, 7]
    assert suffix_dedup.previous_factors(keys, np.array([2, 2, 2]), 16).tolist() == [0, 0, 0]


def test_previous_factors_against_brute_force():
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 99, 16).astype(np.uint8)) for _ in range(300)] * 2
    ids = rng.integers(0, 20, len(texts))
    keys = [np.array([int.from_bytes(t[k : k + 8], "big") for t in texts], np.uint64) for k in (0, 8)]
    got = suffix_dedup.previous_factors(keys, ids, 16)
    for t, i, factor in zip(texts, ids, got, strict=True):
        want = max((next((k for k in range(16) if o[k] != t[k]), 16) for o, j in zip(texts, ids, strict=True) if j < i), default=0)
        assert (factor == 16) == (want == 16) and factor <= want


def test_cut_texts_in_sections_and_with_hot_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PORTION", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1000)
    monkeypatch.setattr(suffix_dedup, "MOST_BUCKETS", 3)
    monkeypatch.setattr(suffix_dedup, "SECTION", 500)
    monkeypatch.setattr(suffix_dedup, "HELD", 4000)
    rng = random.Random(3)
    common = "the terms of the licence that all of these texts hold in common here"
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for k in range(80):
        own = "".join(rng.choices(letters, k=rng.randint(0, 200)))
        rows.append((k, own + common[rng.randint(0, 9) : rng.randint(30, 68)] + "-" * rng.randint(0, 120) + own[:40] + (rows[-1][1][20:110] if rows and k % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute_cut([(k, t.encode()) for k, t in rows]), key=str)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.deduplicate(docs).collect()), key=str)
    assert got == want
    assert suffix_dedup.Layout.of(sum(len(t) for _, t in rows), 3).sections > 5


def test_owners_hold_ranges_of_buckets(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id as doc_id", "cast(id % 300 as string) as text").repartition(5)
    seen = []
    plain = exact_dedup.written

    def watched(df, name):
        if name == "dedup-chain":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
            parts = df.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).orderBy("low").collect()
            seen.append([(x.low, x.high) for x in parts])
        return plain(df, name)

    monkeypatch.setattr(exact_dedup, "written", watched)
    assert exact_dedup.membership(docs, capacity=8).count() == 600
    plan, ranges = seen[:2]
    # Bodies go to their owner by its number, and to nobody else.
    assert plan.count("Exchange shufflepartitionidpassthrough") == 1 and "Exchange hashpartitioning(task" not in plan
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_hot_probe_keys_are_dealt_over_a_grid(spark, monkeypatch):
    """One key of 100,000 rows; a pair of what asks and what is stored meets exactly once."""
    n, side = 100_000, 40
    both = simhash.ASKING | simhash.STORED
    rows = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("fp"), F.lit(both).cast("tinyint").alias("kind"), F.lit(side).cast("long").alias("side"))
    dealt = simhash._dealt(rows)
    assert dealt.count() <= 2 * n * side  # not n * side * side
    assert dealt.groupBy("key").count().count() == side * side
    few = spark.range(60).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("fp"), F.when(F.col("id") % 3 == 0, simhash.ASKING).when(F.col("id") % 3 == 1, simhash.STORED).otherwise(both).cast("tinyint").alias("kind"), F.lit(4).cast("long").alias("side"))
    cells = defaultdict(lambda: ([], []))
    for x in simhash._dealt(few).collect():
        for k, bit in enumerate((simhash.ASKING, simhash.STORED)):
            if x.kind & bit:
                cells[x.key][k].append(x.fp)
    met = Counter((a, b) for asks, holds in cells.values() for a in asks for b in holds)
    assert met == Counter((a, b) for a in range(60) for b in range(60) if a % 3 != 1 and b % 3 != 0)
