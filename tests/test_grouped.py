"""Fits for many groups, orbit files by validity, and bursts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.operators import grouped, orbits
from echofield.sources import sentinel1


def test_polynomials_of_groups_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for g in range(40):
        n = int(rng.integers(6, 30))
        x = rng.uniform(1e5, 1e5 + 50, n) if g % 2 else rng.uniform(-3, 3, n)
        y, z = rng.normal(0, 5, n), rng.normal(1000, 1, n)
        rows += [(g, *map(float, v)) for v in zip(x, y, z, strict=True)]
        want[g] = [np.polynomial.Polynomial.fit(x, v, 3) for v in (y, z)], x
    got = grouped.polynomials(spark.createDataFrame(rows, "g int, x double, y double, z double"), ["g"], "x", ["y", "z"], 3).collect()
    assert len(got) == 40
    for r in got:
        fits, x = want[r.g]
        if r.g % 2 == 0:  # coefficients of far-off x can't be told from each other in doubles
            for fit, poly in zip(fits, (r.y_poly, r.z_poly), strict=True):
                assert np.allclose(np.polynomial.Polynomial(poly)(x), fit(x), atol=1e-6)


def test_few_samples_give_what_fits(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 7.0), (2, 0.0, 1.0), (2, 1.0, 3.0)], "g int, x double, y double")
    got = {r.g: np.polynomial.Polynomial(r.y_poly) for r in grouped.polynomials(df, ["g"], "x", ["y"], 2).collect()}
    assert got[1](2.0) == pytest.approx(6.0) and got[2](np.array([0.0, 1.0])) == pytest.approx([1.0, 3.0])
    assert grouped.polynomials(df.limit(0), ["g"], "x", ["y"], 2).count() == 0


def test_surfaces_of_rows(spark):
    rng = np.random.default_rng(2)
    xs, ys = rng.uniform(-500, 500, (5, 20)), rng.uniform(-1e4, 1e4, (5, 20))
    c = rng.normal(0, 1, (5, 3, 2))
    values = np.array([np.polynomial.polynomial.polyval2d(x, y, k) for x, y, k in zip(xs, ys, c, strict=True)])
    df = spark.createDataFrame([(k, xs[k].tolist(), ys[k].tolist(), values[k].tolist()) for k in range(5)], "k int, x array<double>, y array<double>, v array<double>")
    for r in grouped.surfaces(df, "x", "y", ["v"], (2, 1)).collect():
        assert np.allclose(r.v_poly, c[r.k], rtol=1e-6, atol=1e-9)


def test_orbit_files_by_validity_rank_and_creation(spark):
    products = spark.createDataFrame([(1, "A", 1000.0, 1100.0), (2, "A", 90_000.0, 90_100.0), (3, "B", 1000.0, 1100.0), (4, "A", 86_390.0, 86_500.0)], "product int, mission string, start double, stop double")
    files = spark.createDataFrame(
        [("old", "A", 0, 1.0, 0.0, 86_400.0), ("new", "A", 0, 2.0, 0.0, 86_400.0), ("precise", "A", 1, 0.0, 80_000.0, 100_000.0), ("short", "A", 2, 9.0, 1000.0, 1101.0), ("other", "C", 5, 1.0, 0.0, 1e6)],
        "file string, mission string, rank int, created double, valid_from double, valid_to double",
    )
    assert {(r.product, r.file) for r in orbits.assigned(products, files).collect()} == {(1, "new"), (2, "precise"), (4, "precise")}
    own = products.select("product", F.col("start").alias("t"), *(F.lit(0.0).alias(a) for a in "xyz"))
    states = spark.range(200).select(F.lit("precise").alias("file"), (86_300.0 + F.col("id") * 10).alias("t"), *(F.col("id").cast("double").alias(a) for a in "xyz"))
    found = orbits.overridden(products, own, files, states, reach=5.0).collect()
    held = {(r.product, r.source): sorted(x.t for x in found if (x.product, x.source) == (r.product, r.source)) for r in found}
    # A file without state vectors near the product leaves the product's own.
    assert held == {(1, "product"): [1000.0], (2, "product"): [90_000.0], (3, "product"): [1000.0], (4, "precise"): [86_390.0 + 10 * k for k in range(12)]}


def test_manifest_files_by_name(spark, tmp_path):
    href = lambda kind, h: f"<dataObject repID='{kind}'><byteStream><fileLocation href='./{h}'/></byteStream></dataObject>"
    text = (
        "<x>" + href("s1Level1MeasurementSchema", "measurement/a-1.tiff") + href("s1Level1MeasurementSchema", "measurement/b-1.tiff") + href("s1Level1ProductSchema", "annotation/a-1.xml")
        + href("s1Level1NoiseSchema", "annotation/calibration/noise-a-1.xml") + href("s1Level1CalibrationSchema", "annotation/calibration/calibration-a-1.xml") + href("s1Level1QuickLookSchema", "preview/x.png") + "</x>"
    )
    (tmp_path / "manifest.safe").write_text(text)
    folder = f"{tmp_path}/"
    rows = sentinel1.manifest_files(spark.createDataFrame([(folder + "manifest.safe",)], "path string")).orderBy("name").collect()
    one = {"folder": folder, "name": "a-1", "data": folder + "measurement/a-1.tiff", "product": folder + "annotation/a-1.xml"}
    assert rows[0].asDict() == one | {"noise": folder + "annotation/calibration/noise-a-1.xml", "calibration": folder + "annotation/calibration/calibration-a-1.xml"}
    assert rows[1].data == folder + "measurement/b-1.tiff" and rows[1].product is None


def test_nearest_polynomials(spark):
    row = spark.createDataFrame([([0.0, 3.0, 6.0], ["a", "b", "c"])], "t array<double>, p array<string>")
    pick = lambda m: sentinel1._nearest(F.col("t"), F.lit(m), F.col("p"))[0]
    assert row.select(pick(1.4), pick(1.5), pick(4.6), pick(99.0)).first() == ("a", "a", "c", "c")
