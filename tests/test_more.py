from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.functions import geodesy
from echofield.operators import grids, measures, spectral
from echofield.plans import collects, measuring, views
from echofield.sources import cphd

SF = "/root/testdata/sf0.001"
SCP = (geodesy.SEMI_MAJOR, 0.0, 0.0)
ARP = ([7000000.0, 3.0], [-1000.0, 7500.0], [500000.0, 10.0])


def grid(**changes) -> grids.Grid:
    base = dict(kind="PLANE", scp=SCP, arp=ARP, coa_time=[[0.1, 1e-6], [1e-6]], row_spacing=2.0, col_spacing=3.0, scp_row=2, scp_col=2, row=(0.0, 0.0, -1.0), col=(0.0, 1.0, 0.0))
    return grids.Grid(**{**base, **changes})


def contours(spark, g):
    px = spark.range(25).select(F.expr("id div 5").alias("r"), (F.col("id") % 5).alias("c"))
    return grids.with_contours(px, g).collect()


def at(p, t):
    return sum(c * t**k for k, c in enumerate(p))


def slope(p, t):
    return sum(k * c * t ** (k - 1) for k, c in enumerate(p) if k)


def test_plane_grid(spark):
    for x in contours(spark, grid()):
        u, v = (x.r - 2) * 2.0, (x.c - 2) * 3.0
        t = 0.1 + 1e-6 * v + 1e-6 * u
        arp, vel = np.array([at(p, t) for p in ARP]), np.array([slope(p, t) for p in ARP])
        back = arp - (np.array(SCP) + np.array([0, v, -u]))
        assert x.range == pytest.approx(np.linalg.norm(back)) and x.rate == pytest.approx(vel @ back / np.linalg.norm(back))


def test_range_azimuth_grid(spark):
    for x in contours(spark, grid(kind="RGAZIM", algorithm="RGAZCOMP", azimuth_scale=1e-6)):
        u, v = (x.r - 2) * 2.0, (x.c - 2) * 3.0
        t = 0.1 + 1e-6 * (u + v)
        arp, vel = np.array([at(p, t) for p in ARP]), np.array([slope(p, t) for p in ARP])
        back = arp - np.array(SCP)
        r = np.linalg.norm(back)
        assert x.range == pytest.approx(r + u) and x.rate == pytest.approx(vel @ back / r - np.linalg.norm(vel) * 1e-6 * v)


def test_polar_grid(spark):
    angle, scale = [0.0, 0.01], [1.0, 0.002, 0.1]
    for x in contours(spark, grid(kind="RGAZIM", algorithm="PFA", polar_angle=angle, frequency_scale=scale)):
        u, v = (x.r - 2) * 2.0, (x.c - 2) * 3.0
        t = 0.1 + 1e-6 * (u + v)
        back = np.array([at(p, t) for p in ARP]) - np.array(SCP)
        th = at(angle, t)
        assert x.range == pytest.approx(np.linalg.norm(back) + at(scale, th) * (u * math.cos(th) + v * math.sin(th)))


def test_zero_doppler_grid(spark):
    for x in contours(spark, grid(kind="RGZERO", approach_time=[0.0, 1e-4], approach_range=800_000.0, doppler_rate_scale=[[1.0, 0.0], [0.0, 0.0]])):
        u, v = (x.r - 2) * 2.0, (x.c - 2) * 3.0
        dt = 0.1 + 1e-6 * (u + v) - 1e-4 * v
        speed2 = sum(slope(p, 1e-4 * v) ** 2 for p in ARP)
        r = math.sqrt((800_000 + u) ** 2 + speed2 * dt**2)
        assert x.range == pytest.approx(r) and x.rate == pytest.approx(speed2 * dt / r)


def test_grids_without_their_metadata_are_planes(spark):
    assert grid(kind="RGZERO").usable == grid(kind="RGAZIM", algorithm="PFA").usable == "PLANE"


def test_terrain_on_a_slope(spark):
    dem = spark.range(-2, 3).select(F.col("id").alias("ilat")).join(spark.range(-2, 3).select(F.col("id").alias("ilon"))).withColumn("elev", 100.0 + 50.0 * F.col("ilat"))
    px = spark.createDataFrame([(2, 2), (0, 4)], "r long, c long")
    rows = grids.to_terrain(px, grid(), dem, 1.0, 0.0, 200.0).collect()
    assert len(rows) == 2
    for x in rows:
        assert x.height == pytest.approx(100 + 50 * x.lat, abs=1e-3)


def test_blocks_with_halos_equal_the_whole(spark):
    px = views.pixels(spark, SF).where("r < 20").select("r", "c", "re", "im")

    def blur(z):
        out = z.copy()
        out[1:-1] = z[:-2] + z[1:-1] + z[2:]
        return out

    got = {(x.r, x.c): x.re for x in measures.by_blocks(px, 6, 2, blur, 20).collect()}
    whole = px.toPandas().pivot(index="r", columns="c", values="re").to_numpy()
    want = blur(whole)
    assert len(got) == 20 * 32 and all(abs(got[r, c] - want[r, c]) < 1e-12 for r in range(20) for c in range(32))


def test_registry():
    @measures.registered("twice")
    def twice(a):
        return a * 2

    assert measures.REGISTRY["twice"](4) == 8


def test_axes(spark):
    bins = spark.range(5).withColumnRenamed("id", "k")
    fast = [x.gigahertz for x in measures.fast_time_axis(bins, 64.0, 0.5, 5).orderBy("k").collect()]
    assert fast[2] == pytest.approx(64.0 * geodesy.LIGHT / 2 / 1e9) and fast[-1] - fast[0] == pytest.approx(geodesy.LIGHT / 1e9)
    slow = measures.slow_time_axis(bins, 5, 10.0, 4.0, 1.0, fill=1.5).orderBy("k").collect()
    assert slow[2].seconds == 5.0 and slow[0].polar_angle == -3.0 and slow[0].azimuth == 358.0


def test_registration_finds_a_shift(spark):
    rng = np.random.default_rng(9)
    spectrum = np.zeros((16, 16), complex)
    spectrum[:5, :5] = rng.normal(size=(5, 5)) + 1j * rng.normal(size=(5, 5))
    k = np.fft.fftfreq(16)
    shifted = spectrum * np.exp(-2j * np.pi * (k[:, None] * 2.3 + k[None, :] * -1.5))

    def lines(s):
        z = np.fft.ifft2(s)
        return spark.createDataFrame([(i, [(float(v.real), float(v.imag)) for v in row]) for i, row in enumerate(z)], "r long, z array<struct<re:double,im:double>>")

    dr, dc = measures.registration(lines(spectrum), lines(shifted))
    assert (abs(dr), abs(dc)) == (pytest.approx(2.3, abs=0.051), pytest.approx(1.5, abs=0.051))


def test_aperture_weights(spark):
    assert measures.aperture_weights("HAMMING", 9)[4] == pytest.approx(1.0)
    px = views.pixels(spark, SF).where("r < 9").select("r", "c", "re", "im")
    out = measures.weighted_aperture(px, "GAUSSIAN", 9, 32, cols=False).where("r = 4").orderBy("c").collect()
    assert [x.re for x in out] == [x.re for x in px.where("r = 4").orderBy("c").collect()]
    with pytest.raises(ValueError):
        measures.aperture_weights("other", 3)


def test_reramped_lines_get_longer(spark):
    lines = views.lines(spark, SF).where("r < 3")
    out = measures.reramped(lines, 1e12, 1e6, 5e5)
    assert {len(x.z) for x in out.collect()} == {48}


@pytest.mark.parametrize("kind", ["CF8", "CI2", "CI4"])
def test_cphd_round_trip(spark, tmp_path, kind):
    cphd.registered(spark)
    pulses = collects._signals(spark, SF, (6378137.0, 8.0, -12.0)).where("vec < 20")
    if kind != "CF8":
        pulses = pulses.withColumn("z", F.transform("z", lambda x: F.struct((x["re"] * 100).alias("re"), (x["im"] * 100).alias("im"))))
    path = str(tmp_path / "x.cphd")
    cphd.write_cphd(pulses, path, sample_type=kind)
    got = spark.read.format("cphd").load(path).orderBy("vec").collect()
    want = pulses.orderBy("vec").collect()
    assert [x.vec for x in got] == list(range(20))
    for a, b in zip(got, want, strict=True):
        assert (a.tx_x, a.sc0, a.srp_x) == (b.tx_x, b.sc0, b.srp_x) and a.amp_sf is None
        assert np.allclose([(v.re, v.im) for v in a.z], [(v.re, v.im) for v in b.z], atol=0.51 if kind != "CF8" else 1e-6)
    narrow = spark.read.format("cphd").option("signal", "false").load(path)
    assert "z" not in narrow.columns and narrow.count() == 20


def test_upsampled_spectrogram_and_packing(spark):
    px = views.pixels(spark, SF).where("r < 4").select("r", "c", "re", "im")
    again = spectral.unpacked(spectral.packed(px))
    assert px.exceptAll(again).count() == 0


def test_whole_images_reach_the_result(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(700, 64))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    z = vectors[:, ::2] + 1j * vectors[:, 1::2]
    want = z.copy()
    want[1:-1] = z[:-2] + z[1:-1] + z[2:]
    got = {(x.r, x.c): complex(x.re, x.im) for x in measuring.block_function(spark, str(tmp_path)).collect()}
    assert len(got) == 700 * 32 and all(abs(got[r, c] - want[r, c]) < 1e-5 for r in range(700) for c in range(32))
    assert measuring.spectrogram(spark, str(tmp_path)).select("r").distinct().count() == 700


def test_positions_of_a_long_arc_are_fitted_to_a_centimetre(spark, tmp_path):
    spark.range(0, 720_000, 180).select(F.col("id").alias("vec_id"), F.lit(0.0).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = collects.poly_fit_arp(spark, str(tmp_path)).toPandas().sort_values("vec")
    angle = (out.vec.to_numpy() - 250) * 0.00002
    assert len(out) == 4000 and np.abs(out.x - 7e6 * np.cos(angle)).max() < 0.0051 and np.abs(out.y - 7e6 * np.sin(angle)).max() < 0.0051
