"""What SQL can't check: identities, known values and brute force."""

from __future__ import annotations

from datetime import datetime, timedelta

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.functions import geodesy
from echofield.functions.vectors import Vec, rotated
from echofield.operators import catalog, filters, formation, geometry, metadata, raster, spectral
from echofield.plans import collects, views

SF = "/root/testdata/sf0.001"


def line_frame(spark, z: np.ndarray):
    rows = [(k, [(float(x.real), float(x.imag)) for x in line]) for k, line in enumerate(z)]
    return spark.createDataFrame(rows, "r long, z array<struct<re:double,im:double>>")


def array_of(lines) -> np.ndarray:
    return np.array([[complex(x.re, x.im) for x in row.z] for row in lines.orderBy("r").collect()])


@pytest.fixture(scope="module")
def signal() -> np.ndarray:
    rng = np.random.default_rng(5)
    return rng.normal(size=(6, 16)) + 1j * rng.normal(size=(6, 16))


def test_transforms_are_numpys_and_invert(spark, signal):
    lines = line_frame(spark, signal)
    forward = spectral.transformed(lines)
    assert np.allclose(array_of(forward), np.fft.fft(signal, axis=1))
    assert np.allclose(array_of(spectral.transformed(forward, inverse=True)), signal)
    assert np.allclose(array_of(spectral.transformed_2d(lines, shift=False)), np.fft.fft2(signal))
    assert np.allclose(array_of(spectral.turned(lines)), signal.T)


def test_upsampling_keeps_samples(spark, signal):
    got = array_of(spectral.upsampled(line_frame(spark, signal), 32))
    assert np.allclose(got[:, ::2], signal)


def test_weights_and_broadening():
    assert spectral.broadening(np.ones(64)) == pytest.approx(0.886, abs=2e-3)
    assert spectral.broadening(spectral.weights("TAYLOR", 64)) > 1.0
    assert np.allclose(spectral.weights("KAISER", 9, beta=3.0), np.kaiser(9, 3.0))
    assert np.allclose(spectral.weights("HAMMING", 9), np.hamming(9))
    with pytest.raises(ValueError):
        spectral.weights("none", 4)


def test_zero_deskew_and_uniform_deweight_pass(spark):
    px = views.pixels(spark, SF)
    assert spectral.deskewed(px, [0.0, 0.0], -1, 1.0, 0) is px
    lines = views.lines(spark, SF)
    assert spectral.deweighted(lines, "UNIFORM") is lines


def test_spectrogram_finds_a_tone(spark):
    n = np.arange(256)
    rows = spectral.spectrogram(line_frame(spark, np.exp(2j * np.pi * n * 16 / 256)[None, :])).toPandas()
    peak = rows.loc[rows.groupby("frame").db.idxmax()]
    assert peak.bin.nunique() == 1


def test_coherence_of_an_image_with_itself(spark):
    from echofield.operators import change

    px = views.pixels(spark, SF).where("r < 40")
    pair = px.select("r", "c", F.col("re").alias("ar"), F.col("im").alias("ai"), F.col("re").alias("br"), F.col("im").alias("bi"))
    values = [x.coherence for x in change.coherence(pair).collect()]
    assert np.allclose(values, 1.0)


def test_prefix_sums_equal_window_sums(spark):
    px = views.pixels(spark, SF).where("r < 60")
    one = {(x.r, x.c): x.re for x in raster.prefix_window_sums(px, "re", 3, 60).collect()}
    two = {(x.r, x.c): x.re for x in raster.window_sums(px, ["re"], 3, 0).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_bad_ranges_and_sizes_are_errors(spark):
    with pytest.raises(ValueError):
        raster.checked_range(3, 2, 10)
    px = views.pixels(spark, SF)
    with pytest.raises(ValueError):
        raster.stacked([px, px.where("r < 3")])
    with pytest.raises(ValueError):
        filters.speckle(px, "none")


def test_looks_of_speckle(spark):
    rng = np.random.default_rng(2)
    z = (rng.normal(size=(40, 40)) + 1j * rng.normal(size=(40, 40))) / math.sqrt(2)
    px = spectral.unpacked(line_frame(spark, z))
    found = filters.looks(filters.local_statistics(px, 2), 2, 40, 40).first().looks
    assert 1.0 < found < 6.0


def test_geodetic_and_back(spark):
    points = spark.createDataFrame([(la, lo, h) for la in (-90.0, -45.0, 0.0, 30.0, 89.9, 90.0) for lo in (-179.0, 0.0, 77.0) for h in (-400.0, 0.0, 8000.0, 700_000.0)], "la double, lo double, h double")
    p = geodesy.to_ecf(F.col("la"), F.col("lo"), F.col("h"))
    rows = geodesy.with_geodetic(points.withColumns({"p_x": p.x, "p_y": p.y, "p_z": p.z}), "p").collect()
    for x in rows:
        assert abs(x.lat - x.la) < 1e-8 and abs(x.height - x.h) < 1e-4
        assert abs(x.la) == 90 or abs(x.lon - x.lo) < 1e-8


def test_centre_of_the_earth_has_no_coordinates(spark):
    row = geodesy.with_geodetic(spark.createDataFrame([(0.0, 0.0, 0.0)], "p_x double, p_y double, p_z double"), "p").first()
    assert row.lat is None and row.height is None


@pytest.mark.parametrize(
    ("text", "value"),
    [("10:30:00 S", -10.5), ("-10 30 00", -10.5), ("-10:30:00S", 10.5), ("103000N", 10.5), ("1030", 10.5), ("0773015.5W", -77.504305556), ("77.25E", 77.25), ("10:75:00", None), ("abc", None), ("", None)],
)
def test_angles(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(geodesy.parse_angle(F.col("t"))).first()[0]
    assert got is None if value is None else got == pytest.approx(value, abs=1e-8)


def test_local_frames(spark):
    v = Vec(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    there = geodesy.from_ned(v, F.lit(10.0), F.lit(20.0), F.lit(30.0))
    back = geodesy.to_ned(there, F.lit(10.0), F.lit(20.0), F.lit(30.0))
    up = geodesy.from_plane(Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(35.0))
    north = geodesy.from_plane(Vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turn = rotated(Vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)), Vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(math.pi / 2))
    row = spark.range(1).select(*back, *up, *north, *turn).first()
    assert np.allclose(row, [1, 2, 3, geodesy.SEMI_MAJOR + 1, 0, 0, geodesy.SEMI_MAJOR, 0, 1, 0, 1, 0], atol=1e-6)


def test_rating_constants(spark):
    bits, rating = metadata.quality(F.lit(600e6), F.lit(-20.0), F.lit(40.0))
    row = spark.range(1).select(bits, rating).first()
    assert row[0] == pytest.approx(62.60177, rel=1e-6) and row[1] == pytest.approx(6.07641, rel=1e-6)


def test_findings(spark):
    good = [(1, 10.0, 20.0, 5.0, 40.0, 10.0, "L", "H:H")]
    bad = [(2, 95.0, 200.0, -900.0, 95.0, 400.0, "X", "Q:Q"), (3, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(good + bad, "collect_id int, lat double, lon double, hae double, graze double, azim double, side string, pol string")
    rows = metadata.findings(df, "collect_id", metadata.collect_rules()).collect()
    assert {x.collect_id for x in rows} == {2}
    assert {x.rule for x in rows} == {"latitude", "longitude", "height", "graze", "azimuth", "side", "polarisation"}


def test_groups_hold_each_polarisation_once(spark):
    schema = "collector long, collect_id long, collect_start timestamp, lat double, lon double, hae double, pol string, n_rows int, n_cols int, spacing double, k_ctr double"
    start = datetime(2024, 1, 1)
    frames = spark.createDataFrame([(1, k, start, 0.0, 0.0, 0.0, p, 10, 10, 1.0, 0.5) for k, p in enumerate(["H:H", "H:V", "H:H", "V:V", "H:V", "H:H"])], schema)
    got = {x.collect_id: x.group for x in catalog.same_collect_groups(frames).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 2, 5: 5}
    near = [(0, 0.0, 0.0, 0.0, 10, 0.5), (1, 0.009, 9e-6, 0.9, 10, 0.59), (2, 0.0, 2e-5, 0.0, 10, 0.5), (3, 0.0, 0.0, 1.5, 10, 0.5), (4, 0.0, 0.0, 0.0, 11, 0.5), (5, 0.0, 0.0, 0.0, 10, 0.7), (6, 0.018, 0.0, 0.0, 10, 0.5)]
    frames = spark.createDataFrame([(1, k, start + timedelta(seconds=t), x, 0.0, h, f"p{k}", n, 10, 1.0, f) for k, t, x, h, n, f in near], schema)
    got = {x.collect_id: x.group for x in catalog.same_collect_groups(frames).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}


def greedy_groups(rows):
    """(collect_id, group) by comparing each frame with all groups of before."""
    groups, out = [], {}
    for f in sorted(rows, key=lambda x: x[1]):
        for first, held in groups:
            near = (f[0], f[7], f[8]) == (first[0], first[7], first[8]) and abs((f[2] - first[2]).total_seconds()) < 0.01 and None not in (f[3], first[3])
            if near and abs(f[3] - first[3]) < 1e-5 and abs(f[4] - first[4]) < 1e-5 and abs(f[5] - first[5]) < 1 and abs(f[10] - first[10]) < 1 / (first[9] * first[7]) and f[6] not in held:
                held.add(f[6])
                out[f[1]] = first[1]
                break
        else:
            groups.append((f, {f[6]}))
            out[f[1]] = f[1]
    return out


def test_frames_of_many_chains(spark):
    """Places equal, within and beyond the tolerance, and missing, in chains of a few frames and of hundreds."""
    rng = np.random.default_rng(8)
    start, pols = datetime(2024, 1, 1), ["H:H", "H:V", "V:H", None]
    rows = []
    for k in map(int, rng.permutation(900)):
        place = [float(x) for x in (rng.integers(0, 6, 2) * 6e-6 if k % 3 else rng.integers(0, 9, 2) * 1.0)]
        lat = None if k % 97 == 0 else place[0]
        rows.append((int(rng.integers(2)), k, start + timedelta(milliseconds=int(rng.integers(0, 4)) * 7), lat, place[1], float(rng.choice([0.0, 0.9, 1.8])) if k % 3 else 0.0, pols[rng.integers(4)], 10, 10, 1.0 if k % 5 else 0.5, 0.5 + 0.06 * (k % 2)))
    schema = "collector int, collect_id long, collect_start timestamp, lat double, lon double, hae double, pol string, n_rows int, n_cols int, spacing double, k_ctr double"
    got = catalog.same_collect_groups(spark.createDataFrame(rows, schema)).collect()
    assert {x.collect_id: x.group for x in got} == greedy_groups(rows) and len(got) == 900


def test_frames_of_one_moment_and_place_take_no_time_each(spark):
    """40,000 frames of one collector and polarisation: each is a group, none is compared with all of before."""
    began = time.monotonic()
    frames = spark.range(40_000).selectExpr("1L collector", "id collect_id", "timestamp'2024-01-01' collect_start", "0D lat", "if(id % 2 = 0, 0D, 5e-6D) lon", "0D hae", "'H:H' pol", "10 n_rows", "10 n_cols", "1D spacing", "0.5D k_ctr")
    assert catalog.same_collect_groups(frames).where('group = collect_id').count() == 40_000
    assert time.monotonic() - began < 60


def test_point_target_peaks_where_it_is(spark):
    rows = collects.bp_image(spark, SF).toPandas()
    peak = rows.loc[rows.amplitude.idxmax()]
    assert (peak.r, peak.c) == (5, 10)


def test_selection_by_resolution(spark):
    pulses = views.pulses(spark, SF)
    kept, first, last = formation.selected(pulses, 10.0, 32)
    assert 0 <= first < last <= 32 and 0 < kept.count() <= 500


def test_deskewed_range_keeps_power(spark, signal):
    got = array_of(formation.range_deskewed(line_frame(spark, signal), 1e12, 1e6))
    assert np.allclose((np.abs(got) ** 2).sum(1), (np.abs(signal) ** 2).sum(1))


def test_bilinear_beyond_the_grid_is_null(spark):
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "ilat long, ilon long, elev double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.5, 0.5)], "id int, lat double, lon double")
    got = {x.id: x.elev for x in geometry.bilinear(points, grid, 1.0).collect()}
    assert got == {1: 2.5, 2: 4.0, 3: None}


def test_near_pairs_send_a_row_to_few_cells(spark, monkeypatch):
    from itertools import combinations

    from echofield.operators import catalog

    rows = [(k, (k * 37 % 101) * 0.0004 - 0.02, (k * 53 % 89) * 0.0003 - 0.013, float(k % 11)) for k in range(400)]
    joined = []
    join = type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda left, right, *rest: (joined.append(right.count()), join(left, right, *rest))[1])
    out = catalog.near_pairs(spark.createDataFrame(rows, "collect_id long, lat double, lon double, graze double"))
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if abs(a[1] - b[1]) < 0.001 and abs(a[2] - b[2]) < 0.001 and abs(a[3] - b[3]) < 5}
    assert {(x.a, x.b) for x in out.collect()} == want and want
    assert joined[0] < 3 * len(rows)


def test_near_pairs_of_alike_collects_stay_small_when_written(spark, tmp_path, monkeypatch):
    """Collects of few places, some at the bound, unsorted and over several runs; a repeated and a missing id."""
    import os
    from itertools import combinations

    import numpy as np

    from echofield.operators import catalog

    ids = np.random.default_rng(4).permutation(3000).tolist()
    rows = [(k, (k % 3) * 0.0009, (k % 2) * 0.4, float(k % 7)) for k in ids] + [(None, 0.0, 0.0, 0.0), (5000, None, 0.0, 0.0), (5001, 0.0, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "collect_id long, lat double, lon double, graze double")
    want = {(a[0], b[0]) for a, b in combinations(sorted(rows[:3000]), 2) if abs(a[1] - b[1]) < 0.001 and a[2] == b[2] and abs(a[3] - b[3]) < 5}
    catalog.near_pairs(df).coalesce(1).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs")).toPandas()
    assert len(found) == len(want) and set(zip(found.a.tolist(), found.b.tolist(), strict=True)) == want
    # Collect by collect it took 1.4 bytes for a pair.
    assert sum(os.stat(tmp_path / "pairs" / x).st_size for x in os.listdir(tmp_path / "pairs")) < 0.5 * len(want)
    monkeypatch.setattr(catalog, "RUN", 3)
    twice = catalog.near_pairs(df.where("collect_id < 60").unionByName(df.where("collect_id = 7"))).toPandas()
    small = [p for p in want if max(p) < 60]
    assert sorted(zip(twice.a.tolist(), twice.b.tolist(), strict=True)) == sorted(small + [p for p in small if 7 in p])


def test_angles_near_right_and_straight_ones(spark):
    """Against values of 60 digits; arc sine and arc cosine are too steep there."""
    import math

    from pyspark.sql import functions as F

    from echofield.functions.vectors import Vec, vec

    exact = {78902: (-89.999985017, 179.999989751), 78965: (-89.999963489, 179.999975008), 78711: (-89.999992588, 179.999994941), 78868: (-89.999992720, 179.999995022), 78790: (-90.0, 180.0)}
    rows = [(k, 7000000.0 * math.cos((k - 250.0) * 0.00002), 7000000.0 * math.sin((k - 250.0) * 0.00002), 500000.0, 6378137.0, 0.0, 0.0) for k in exact]
    df = spark.createDataFrame(rows, "vec long, tx_x double, tx_y double, tx_z double, srp_x double, srp_y double, srp_z double")
    velocity = Vec(F.lit(100.0), F.lit(7000.0), F.lit(500.0))
    twist = {r.vec: r.twist for r in geometry.with_angles(df, vec("srp"), vec("tx"), velocity).collect()}
    track = {r.vec: r.track for r in geometry.with_pointing(df, vec("srp"), vec("tx"), velocity).collect()}
    for k, (a, b) in exact.items():
        assert abs(twist[k] - a) < 2e-9 and abs(track[k] - b) < 2e-9
