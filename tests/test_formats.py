from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echofield.operators import algorithms, estimates, viewer
from echofield.sources import blocks, cosar, cphd, nitf, opened, patches, sicd, sio, tiff


@pytest.fixture(scope="module")
def image() -> np.ndarray:
    rng = np.random.default_rng(4)
    return np.round(rng.normal(0, 500, (37, 21))) + 1j * np.round(rng.normal(0, 500, (37, 21)))


@pytest.mark.parametrize("element", ["<f4", ">f4", "<i2", ">i2"])
def test_tiff_of_each_element(spark, tmp_path, image, element):
    path = str(tmp_path / "x.tif")
    tiff.write_tiff(path, image, element, 5)
    got = opened.open_reader(spark, path).where("r >= 3 and r < 30 and c = 4").collect()
    assert {(x.r, x.c): complex(x.re, x.im) for x in got} == {(r, 4): image[r, 4] for r in range(3, 30)}


def test_tiff_of_one_strip(spark, tmp_path, image):
    path = str(tmp_path / "x.tif")
    tiff.write_tiff(path, image, strip_rows=100)
    assert opened.open_reader(spark, path).count() == image.size


def test_cosar_bounds_and_strides_are_the_images(spark, tmp_path, image):
    path = str(tmp_path / "x.cos")
    cosar.write_cosar(path, image)
    got = opened.open_reader(spark, path, rowstride=2, colstride=3).where("r >= 4 and c <= 12").collect()
    assert {(x.r, x.c): complex(x.re, x.im) for x in got} == {(r, c): image[r, c] for r in range(4, 37, 2) for c in range(0, 13, 3)}


def test_cosar_valid_places(spark, tmp_path, image):
    path = str(tmp_path / "x.cos")
    cosar.write_cosar(path, image, np.arange(image.shape[1]) % 5)
    got = {x.r: (x.first, x.last) for x in cosar.valid_places(spark, path, 4).collect()}
    for r in range(image.shape[0]):
        valid = [c for c in range(image.shape[1]) if r >= c % 5]
        assert got[r] == (min(valid), max(valid))


def test_unknown_formats_are_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"nothing of the kind")
    with pytest.raises(ValueError):
        opened.open_reader(spark, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        tiff.tiff_layout(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        cosar.cosar_size(str(tmp_path / "x"))


def test_newton_steps_of_unusable_rows(spark):
    names = [f"{n}_{a}" for n in ("scp", "arp", "vel") for a in "xyz"] + ["range", "rate"]
    rows = [(6378137.0, 0.0, 0.0, 7e6, -1e5, 5e5, 10.0, 7500.0, 20.0, None, 1.0)]
    out = algorithms.to_height_by_newton(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), 0.0).first()
    assert out.out_x is None or np.isnan(out.out_x)


def test_weights_of_flat_and_tapered_spectra():
    flat, _ = estimates.fitted_weights([1.0 + 1e-3 * (k % 2) for k in range(32)])
    places = (np.arange(32) + 16) % 32
    tapered, fit = estimates.fitted_weights((0.54 - 0.46 * np.cos(2 * np.pi * places / 31)).tolist())
    assert tapered and not flat and abs(fit.max() - 1) < 1e-12


def test_windows_of_views():
    assert viewer.window(10, 5, 100, 1) == (8, 12)
    assert viewer.window(1, 5, 100, 2) == (1, 10)
    assert viewer.window(99, 5, 100, 3) == (86, 100)


def test_normalized_where_fields_are_missing(spark):
    row = spark.range(1).select(F.lit(None).cast("array<double>").alias("p"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("array<double>").alias("f"), F.lit(None).cast("int").alias("s"))
    assert row.select(algorithms.is_normalized(F.col("p"), F.col("w"), F.col("f"), F.col("s"))).first()[0] is True


@pytest.mark.parametrize("element", ["<f4", ">i2"])
def test_tiff_of_tasks_is_the_arrays(spark, tmp_path, image, element):
    tiff.write_tiff(str(tmp_path / "x"), image, element, 5)
    tiff.write_pixels(_px(spark, image), str(tmp_path / "y"), *image.shape, element, 5)
    assert (tmp_path / "x").read_bytes() == (tmp_path / "y").read_bytes()


def test_cosar_of_tasks_is_the_arrays(spark, tmp_path, image):
    cosar.write_cosar(str(tmp_path / "x"), image, np.arange(image.shape[1]) % 5)
    cosar.write_pixels(_px(spark, image), str(tmp_path / "y"), *image.shape, F.col("c") % 5)
    assert (tmp_path / "x").read_bytes() == (tmp_path / "y").read_bytes()


def _px(spark, image):
    return spark.createDataFrame([(r, c, float(z.real), float(z.imag)) for (r, c), z in np.ndenumerate(image)], "r long, c long, re double, im double")


@pytest.mark.parametrize("kind", ["sio", "sicd", "cphd"])
def test_no_pixel_passes_the_driver(spark, tmp_path, image, monkeypatch, kind):
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", None)
    path, px = str(tmp_path / "x"), _px(spark, image)
    if kind == "cphd":
        lines = px.orderBy("c").groupBy((F.col("r") * 3).alias("vec")).agg(F.array_sort(F.collect_list(F.struct("c", "re", "im"))).alias("z"))
        cphd.write_cphd(lines.withColumn("tx_time", F.col("vec") * 0.5), path)
        got = opened.open_reader(spark, path).select((F.col("tx_time") / 1.5).cast("long").alias("r"), F.posexplode("z").alias("c", "z")).select("r", "c", "z.*").collect()
    elif kind == "sio":
        sio.write_sio(px, path, *image.shape)
        got = opened.open_reader(spark, path).collect()
    else:
        sicd.write_sicd(px, path, *image.shape, segment_rows=10)
        got = opened.open_reader(spark, path).collect()
    assert {(x.r, x.c): complex(x.re, x.im) for x in got} == dict(np.ndenumerate(image))


@pytest.mark.parametrize(("bands", "mode"), [(("I", "Q"), "P"), (("I", "Q"), "R"), (("I", "Q"), "S"), (("I", "Q"), "B")])
def test_an_image_of_one_block_is_written_and_read_in_strips(spark, tmp_path, image, monkeypatch, bands, mode):
    monkeypatch.setattr(patches, "STRIP", 5 * 8 * image.shape[1])
    monkeypatch.setattr(blocks, "BLOCK", 16 * 8 * image.shape[1])
    packed = []
    monkeypatch.setattr(nitf, "write_patches", lambda p, *rest: (packed.append(p.count()), patches.write_patches(p, *rest)))
    nitf.registered(spark)
    path = str(tmp_path / "x.ntf")
    nitf.write_nitf([(_px(spark, image), nitf.Written(*image.shape, "R", 32, bands, mode, None, extension=nitf.range_direction("ROW_INC")))], path)
    back = spark.read.format("nitf").load(path)
    assert {(x.r, x.c): complex(x.re, x.im) for x in back.collect()} == dict(np.ndenumerate(image))
    reader = nitf.NitfReader(path, {})
    runs = [pd.concat(b.to_pandas() for b in reader.read(x)) for x in reader.partitions()]
    assert packed[0] >= 8 and len(runs) > 1 and max(map(len, runs)) <= 16 * image.shape[1] and sum(map(len, runs)) == image.size


def test_more_blocks_than_a_field_holds():
    w = nitf.Written(320_000, 32, "R", 32, ("I", "Q"), "B", (32, 32))
    fields, n = nitf.parsed(w.subheader(0), nitf.SUBHEADERS["02.10"])
    assert n == len(w.subheader(0)) and fields["NPPBV"] == 32 and fields["NROWS"] == 320_000
