"""Repaired conversations against a search through all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from echofield.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, segment int, place string"


def show(x) -> str:
    return " " if x is None else str(x)


def after_damage(rows: list[tuple]) -> dict[int | None, list[tuple]]:
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for held in out.values():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    return out


def marked(rows: list[tuple]) -> list[str]:
    out, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows: list[tuple], faults: list[str]) -> tuple[int, str, str]:
    """The least (cost, audit) over every choice of edits, with at most one insert at each place."""
    found = []
    choices = [("D",) if f in ("blank", "duplicate") else ("D", "K", "Ruser", "Rassistant") for f in faults]
    gaps = ("", "Iuser", "Iassistant")
    for edits in product(*[x for c in choices for x in (gaps, c)], gaps):
        cost, audit, lines = 0, "", []
        for k, e in enumerate(edits):
            if not e:
                continue
            audit += e[0]
            row = rows[k // 2] if k % 2 else None
            if e == "D":
                cost += 2
                continue
            if row is None:
                cost += 5
                lines.append((e[1:], ""))
                continue
            cost += (5 if faults[k // 2] == "truncated" else 0) + (e[0] == "R")
            lines.append((row[1] if e == "K" else e[1:], row[2]))
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
            found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)))
    return min(found)


def brute(rows: list[tuple]) -> set[tuple]:
    out, held = set(), after_damage(rows)
    for conv in {r[0] for r in rows}:
        lines = held[conv]
        faults = marked(lines)
        turns = [t for t, _, _ in lines if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, text = cheapest(lines, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def result(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def conversations(n: int, most: int) -> list[tuple]:
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Fine.", "So?  \n", "cut", " \t", None, "", "Yes!", "\u0085", "one. two"]
    out = []
    for conv in range(n):
        alternate = rng.random() < 0.5
        for turn in range(rng.randint(1, most)):
            role = ("user", "assistant")[turn % 2] if alternate else rng.choice(roles)
            text = f"{rng.random()}." if rng.random() < 0.5 else rng.choice(texts)
            out.append((conv if conv else None, None if rng.random() < 0.1 else turn + rng.randint(0, 1), role, text, 1, "clash"))
    return out + out[:2]


@pytest.mark.parametrize("segment", [1, 2, 256])
def test_like_a_search_through_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations(60, 3)
    found = result(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert set(found) == brute(rows) and len(found) == len({r[0] for r in rows})


def test_a_long_conversation_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", f"{k}.", f"{k}", ""]), 1, "") for k in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = result(repair.repair(df))
    monkeypatch.setattr(repair, "SEGMENT", 10_000)
    assert cut == result(repair.repair(df)) and len(cut[0][7]) >= 1000


def test_no_rows_left_and_empty_table(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Fine.", 1, "")], SCHEMA)
    assert result(repair.repair(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_folds_stay_in_spark(spark):
    plan = repair.repair(spark.createDataFrame(conversations(3, 3), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
