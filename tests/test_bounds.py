"""What was capped once."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.functions import poly
from echofield.operators import filters


@pytest.mark.parametrize("n", [0, 1, 2, 13, 30])
def test_polynomials_of_any_length_are_shifted(spark, n):
    rng = np.random.default_rng(n)
    c = rng.normal(0, 1, n).tolist()
    row = spark.createDataFrame([(c,)], "c array<double>").select(poly.shifted(F.col("c"), F.lit(0.5)).alias("s")).first()
    want = np.polynomial.Polynomial(c or [0.0])(np.polynomial.Polynomial([0.5, 1.0])).coef[:n]
    assert np.allclose(row.s, np.pad(want, (0, n - len(want))), rtol=1e-9, atol=1e-9)


def test_frost_radius_follows_from_the_most_even_window(spark):
    rng = np.random.default_rng(3)
    a = 1 + 0.4 * rng.random((14, 11))
    px = spark.createDataFrame([(r, c, float(a[r, c]), 0.0) for r in range(14) for c in range(11)], "r long, c long, re double, im double")
    i = a**2
    variation = np.array([[(lambda w: w.var() / w.mean() ** 2)(i[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3]) for c in range(11)] for r in range(14)])
    damping = 20.0
    radius = math.ceil(-math.log(0.01) / (math.sqrt(2) * damping * variation.min()))
    assert filters.frost_radius(px, 2, damping) == radius > 2
    rr, cc = np.mgrid[:14, :11]
    want = np.zeros_like(i)
    for r in range(14):
        for c in range(11):
            near = (abs(rr - r) <= radius) & (abs(cc - c) <= radius)
            w = np.exp(-damping * variation[r, c] * np.hypot(rr - r, cc - c)) * near
            want[r, c] = (w * i).sum() / w.sum()
    want = np.sqrt(want * i.mean() / want.mean())
    for x in filters.frost(px, damping=damping).collect():
        assert x.amplitude == pytest.approx(want[x.r, x.c], rel=1e-9)
    even = px.select("r", "c", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    with pytest.raises(ValueError):
        filters.frost_radius(even)


def test_frost_of_lines_in_tiles(spark, monkeypatch):
    """Tiles smaller than the image, an absent pixel, and one without a value."""
    monkeypatch.setattr(filters, "TILE", 8)
    rng = np.random.default_rng(5)
    z = rng.normal(0, 1, (21, 19, 2))
    cells = [(r, c, *map(float, z[r, c])) for r in range(21) for c in range(19)]
    schema = "r long, c long, re double, im double"
    px = spark.createDataFrame([x for x in cells if x[:2] != (8, 7)], schema).withColumn("re", F.when(F.col("r") * 100 + F.col("c") != 1509, F.col("re")))
    i, n = (z**2).sum(2), np.ones((21, 19))
    i[8, 7] = n[8, 7] = i[15, 9] = 0.0
    rr, cc = np.mgrid[:21, :19]
    out = np.zeros_like(i)
    for r in range(21):
        for c in range(19):
            s, m, q = (x[max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].sum() for x in (i, n, i * i))
            k = (q / m - (s / m) ** 2) / (s / m) ** 2
            w = np.exp(-k * np.hypot(rr - r, cc - c)) * n * (abs(rr - r) <= 3) * (abs(cc - c) <= 3)
            out[r, c] = (w * i).sum() / w.sum()
    there = n > 0
    want = np.sqrt(out * (i[there].sum() / (there.sum() - 1)) / out[there].mean())
    got = filters.frost(px, radius=3).collect()
    assert sorted((x.r, x.c) for x in got) == sorted(zip(*map(list, np.nonzero(there)), strict=True))
    for x in got:
        assert x.amplitude == pytest.approx(want[x.r, x.c], rel=1e-9)
    whole = spark.createDataFrame(cells, schema)
    lines = spark.createDataFrame([(r, [(float(a), float(b)) for a, b in z[r]]) for r in range(21)], "r long, z array<struct<re: double, im: double>>")
    want = {(x.r, x.c): x.amplitude for x in filters.frost(whole, radius=3).collect()}
    got = {(x.r, x.c): x.amplitude for x in filters.frost(lines, radius=3).collect()}
    assert got == pytest.approx(want, rel=1e-12) and filters.frost_radius(lines) == filters.frost_radius(whole)


def shuffled(spark, df) -> int:
    """Bytes that a run writes to shuffles."""
    context = spark.sparkContext._jsc.sc()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def written() -> dict[int, int]:
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, doubles, None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = set(written())
    df().write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def test_frost_shuffles_little_more_than_the_image(spark):
    lines = spark.range(2000).select(F.col("id").alias("r"), F.expr("transform(sequence(0, 31), c -> struct(hash(id, c) / 1e9 as re, hash(c, id) / 1e9 as im))").alias("z"))
    lines = lines.localCheckpoint()
    assert shuffled(spark, lambda: filters.frost(lines, radius=9)) < 20 * 2000 * 32
