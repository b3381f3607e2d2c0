"""Documents with every odd case that the operators define a result for."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, key string, body string, salt int"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["an", "be", "cor", "du", "el", "fa", "gri", "hu", "is", "ko"]
    common = ["the", "of", "and", "in"]
    out = [rng.choice(common) if rng.random() < 0.3 else "".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(words)]
    return " ".join(out)


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(" the ", " that ", 1)
    texts = [
        base,
        base.replace(" ", "\n", 3),
        near,
        None,
        "",
        " \t\n",
        "word",
        "two words",
        prose(2, 200) + " " + base[:300],
        prose(3, 30_000),
        "é" * 300 + " Ünïcode " + prose(4, 20),
        base,
        "x" * 500,
        "x" * 400,
        prose(5, 80) + " MIT License " + prose(6, 5),
    ]
    out = [(k, t, "en" if k % 3 else None, None if k % 5 == 4 else f"src{k % 4}", None if t is None else len(t), "clash", k, "k", "b", 1) for k, t in enumerate(texts)]
    out.append((None, base, None, None, None, None, None, None, None, None))
    out.append((7, "two words", "en", "src3", 9, "clash", 7, "k", "b", 1))  # a repeated row
    return out


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """With null ids, texts and sources, ties, a repeated row and clashing columns."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
