"""Files in compressed strips."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.plans import catalog, products
from echofield.sources import ceos, strips


@pytest.mark.parametrize("strip", [64, 100, 1 << 20])
def test_a_file_in_strips_reads_as_it_is(spark, tmp_path, strip):
    """Pieces of 30 bytes that cross strips, with a gap, behind a head that is longer than a strip."""
    want, head, path = bytearray(bytes(900)), bytes(range(80)), str(tmp_path / "x.strips")
    places = [80 + 30 * k for k in range(27) if not 10 <= k < 19]
    for at in places:
        want[at : at + 30] = str(at).rjust(30).encode()
    want[:80] = head
    rows = spark.createDataFrame([(a,) for a in places[::-1]], "at long").repartition(3)
    strips.write_strips(rows, F.lpad(F.col("at").cast("string"), 30, " ").cast("binary"), 30, path, len(want), head, strip)
    with strips.opened(path) as f:
        assert f.size() == len(want)
        for at, n in [(0, 900), (0, 10), (70, 30), (99, 2), (150, 400), (380, 200), (890, 50), (900, 5)]:
            assert f.read_at(n, at) == bytes(want[at : at + n])
    assert not strips.opened(path).held
    assert {int(x) for x in os.listdir(path) if x != strips.ABOUT} == {k for a in places for k in (a // strip, (a + 29) // strip)}


def test_no_pieces(spark, tmp_path):
    path = str(tmp_path / "x.strips")
    strips.write_strips(spark.createDataFrame([], "at long"), F.lit(b"x"), 1, path, 12, b"a chain here")
    with strips.opened(path) as f:
        assert f.read_at(50, 0) == b"a chain here"


def test_a_chain_in_strips(spark, tmp_path):
    """Records cross ranges and strips."""
    path, n = str(tmp_path / "x.strips"), 500
    head = struct.pack(">IBBBBI", 1, 1, 192, 1, 1, 40) + bytes(28)
    data = F.concat(F.unhex(F.lpad(F.hex(F.col("k") + 2), 8, "0")), F.unhex(F.lit("010a01010000005a")), F.lit(b" " * 78))
    strips.write_strips(spark.range(n).select(F.col("id").alias("k"), (40 + 90 * F.col("id")).alias("at")), data, 90, path, 40 + 90 * n, head, 1000)
    found = ceos.records(spark, path, 700)
    assert sorted((r["at"], r["number"]) for r in found.collect()) == [(0, 1), *((40 + 90 * k, k + 2) for k in range(n))]
    assert {bytes(r["content"][4:]) for r in ceos.contents(found.where("type = 10"), path).collect()} == {bytes.fromhex("010a01010000005a") + b" " * 78}


@pytest.mark.parametrize("name", ["ceos_records", "ceos_products", "ceos_positions"])
def test_leaders_take_little_disk(spark, tmp_path, monkeypatch, name):
    """Their 2,502 bytes for a collect, mostly spaces, were on disk as they are."""
    monkeypatch.setattr(products, "scratch_file", lambda _, x: str(tmp_path / x))
    monkeypatch.setattr(ceos, "scratch_file", lambda _, x: str(tmp_path / x))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
    used = sum(os.stat(os.path.join(at, x)).st_size for at, _, names in os.walk(tmp_path) for x in names)
    assert used < 15_000 * 2502 / 10


def test_texts_of_leaders(spark):
    """Numbers are laid out with seven digits, as before."""
    values = [0.0, 0.1 + 0.2, -59.9, 179.9 * 17, -500.0, 1e6 + 3590, 1 / 3, -1e-9, 49000.0, *np.random.default_rng(1).uniform(-4000, 4000, 200).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["t"] for r in df.select(products._text(F.col("v")).alias("t")).collect()] == [f"{v:.7f}".replace("-0.0000000", "0.0000000") for v in values]
