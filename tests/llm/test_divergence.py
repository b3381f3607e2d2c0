"""The audit of sources against a plain count of everything."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from echofield.llm import divergence

TERMS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows: list[tuple]) -> set[tuple]:
    """rows: lang, source, text."""
    docs, of_group = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = TERMS.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in text))
        docs[lang].update(set(terms))
        of_group[lang, source].update(terms)
    out = set()
    for lang in {x for x, _ in of_group}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        sources = [s for x, s in of_group if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(of_group[lang, s])

        def chances(n):
            total = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // total for t in kept}

        q = chances(whole)
        p = {s: chances(of_group[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if of_group[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out.update((lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found))
    return out


def result(df) -> list[tuple]:
    return [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]


def texts(n: int) -> list[tuple]:
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["É", "é", "ZÜRICH", "zÜrich"]
    out = []
    for k in range(n):
        step = 1 + k % 7
        body = " ".join(words[(k * 13 + j * j * step) % len(words)] for j in range(5 + k % 40))
        out.append((None if k % 11 == 0 else "en" if k % 3 else "de", None if k % 13 == 0 else f"s{k % 9}", None if k % 17 == 0 else body))
    return [*out, *out[:30], ("xx", "alone", "few words"), ("yy", "a", None), ("yy", "b", "1 2 3"), ("yy", None, "")]


SCHEMA = "lang string, source string, text string"


@pytest.mark.parametrize("tiny", [False, True])
def test_like_brute_force(spark, monkeypatch, tiny):
    if tiny:  # many blocks, chunks and slabs; facts joined by shuffle
        for name, value in (("BLOCK", 2), ("CHUNK", 4), ("FEWEST", 2), ("SLAB", 3), ("BROADCAST", 0)):
            monkeypatch.setattr(divergence, name, value)
    rows = texts(400)
    found = result(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)


def test_odd_rows(odd, odd_rows, none):
    assert set(result(divergence.audit(odd))) == brute([(r[2], r[3], r[1]) for r in odd_rows])
    assert divergence.audit(none).count() == 0


def test_probability_is_exact(spark):
    pairs = [(2, 2), (2, 9 * 10**15), (9 * 10**15, 9 * 10**15), (123_456_789_012, 987_654_321_098_765), (7, 3_000_000)]
    df = spark.createDataFrame(pairs, "n long, total long")
    for r in df.select("n", "total", divergence.probability(df.n, df.total).alias("p")).collect():
        assert r.p == 1 + 10**9 * r.n // r.total
