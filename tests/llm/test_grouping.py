"""Packing by linear grouping: ids, the plan, and every piece in its place."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from echofield.llm import grouping

TEXTS = [
    "plain words, one space",
    "two  spaces and\n\ntwo line ends",
    " begins and ends ",
    "\nbegins with a line end\n",
    "a\n \nb \n c\t d",
    "it's they'll we've I'm don't",
    "a <|endoftext|> b<|endoftext|>c",
    "œuvre ÀÉÖ ×÷ ÿ ½ ²³   \u0085 x y",
    "日本語 テキスト emoji 👍🏽 é",
    "x" * 5000,
    "1234567890 " * 300,
    "\x1c \x1d\x1ez \x00",
    "",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(grouping.default_vocabulary())


def ids_of(tokenizer, text) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, grouping.END_ID]


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(3)
    pieces = ["the", " ", " ", "\n", "  ", "'s", "Über", ".", ",x", "7", "\t", "<|endoftext|>", "é", "…", "\r\n", "ñ", "日"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(3000)]
    encoder = grouping.Encoder(grouping.default_vocabulary())
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, text)[:-1], text


def check(rows: list, texts: list[tuple], tokenizer) -> int:
    """All contract columns against the untouched tokenizer; returns the number of sequences."""
    want, got = Counter(), Counter()
    for doc_id, text in texts:
        ids = ids_of(tokenizer, text)
        n, start = len(ids), 0
        for piece in range(-(-n // 1024)):
            stop = (n - 1) % 1024 + 1 + 1024 * piece
            want[doc_id, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start = stop
    held = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        held[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held)


def corpus(n: int) -> list[tuple]:
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "Zürich"]
    return [(k, " ".join(rng.choices(words, k=rng.choice([3, 40, 200, 500, 700, 900, 2500]) + rng.randint(0, 60)))) for k in range(n)]


@pytest.mark.parametrize("window", [7, 100_000])
def test_packs_all_and_close_to_the_bound(spark, tokenizer, monkeypatch, window):
    monkeypatch.setattr(grouping, "WINDOW", window)
    docs = corpus(600)
    rows = grouping.pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    sequences = check(rows, docs, tokenizer)
    lengths = Counter(r.length for r in rows)
    best = grouping.Plan()
    for n in sorted(lengths, reverse=True):
        best.best_fit(n, lengths[n])
    assert sequences <= best.sequences * 1.02


def test_odd_rows(odd, odd_rows, none, tokenizer):
    check(grouping.pieces(odd).collect(), [(r[0], r[1]) for r in odd_rows], tokenizer)
    assert grouping.pieces(none).count() == 0


def test_sequences_hold_the_ids(odd, odd_rows, tokenizer):
    want = Counter(tuple(ids_of(tokenizer, r[1])) for r in odd_rows)
    of_doc = defaultdict(list)
    for s in grouping.sequences(odd).collect():
        for k, p in enumerate(s.parts):
            end = s.parts[k + 1].offset if k + 1 < len(s.parts) else len(s.ids)
            of_doc[p.doc_id].append((p.piece, tuple(s.ids[p.offset : end])))
    once = [i for i, n in Counter(r[0] for r in odd_rows).items() if n == 1]
    assert all(want[tuple(x for _, ids in sorted(of_doc[i]) for x in ids)] for i in once)


def test_groups_have_equal_cardinality():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in range(301, 1024)}
    groups = grouping.grouped(counts, 16)
    sizes = [sum(m for _, m in g) for g in groups]
    assert len(groups) == 16 and max(sizes) - min(sizes) <= 1
    back = Counter()
    for g in groups:
        for n, m in g:
            back[n] += m
    assert back == counts


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes, values = rng.integers(5, 30, 4), rng.random(4)
        room = 60
        best = max(
            values @ np.array([a, b, c, d])
            for a in range(13) for b in range(13) for c in range(13) for d in range(13)
            if sizes @ np.array([a, b, c, d]) <= room
        ) if sizes.min() >= 20 else None
        taken = grouping.knapsack(sizes, values, room)
        assert sizes @ taken <= room
        if best is not None:
            assert abs(values @ taken - best) < 1e-9


def test_configurations_reach_the_optimum():
    # Thirds and halves: 600 of 512 and 300 of 341 need 300 + 100 sequences.
    found = grouping.configurations([512, 341], [600, 300], 1024)
    assert sum(n for _, n in found) == 400
    # Mixed pairs: 700 goes with 324 only.
    found = grouping.configurations([700, 324], [50, 50], 1024)
    assert [(c.tolist(), n) for c, n in found] == [[[1, 1], 50]] or sum(n for _, n in found) == 50


def test_plan_takes_every_document_once():
    rng = random.Random(8)
    for _ in range(20):
        counts = {rng.randint(1, 1023): rng.randint(1, 4000) for _ in range(rng.randint(1, 300))}
        plan = grouping.plan(dict(counts))
        taken, filled = Counter(), Counter()
        for r in plan.runs:
            assert r.start == taken[r.length]
            taken[r.length] += r.count
            for k in range(r.count):
                filled[r.sequence + k // r.each] += r.length
        assert taken == counts and max(filled.values()) <= 1024
        assert len(filled) == plan.sequences and len(plan.runs) < 8000
