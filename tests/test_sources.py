from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.operators import catalog
from echofield.plans import collects, views
from echofield.sources import probe, sio, terrain
from echofield.streaming import integrate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def image(tmp_path_factory, spark):
    probe.registered(spark)
    path = str(tmp_path_factory.mktemp("sio") / "image.sio")
    px = views.pixels(spark, SF).where("r < 40 and r <> 7")
    sio.write_sio(px, path, 42, 32)
    return path, {(x.r, x.c): (np.float32(x.re), np.float32(x.im)) for x in px.collect()}


def test_sio_round_trip(spark, image):
    path, want = image
    got = {(x.r, x.c): (x.re, x.im) for x in spark.read.format("sio").load(path).collect()}
    assert len(got) == 42 * 32
    assert all(got[k] == v for k, v in want.items())
    assert got[7, 3] == got[41, 0] == (0.0, 0.0)


def test_sio_pushes_bounds_and_strides(spark, image):
    path, want = image
    part = spark.read.format("sio").option("rowstride", 4).load(path).where("r >= 8 and r < 24 and c = 5")
    assert {(x.r, x.c): (x.re, x.im) for x in part.collect()} == {k: v for k, v in want.items() if 8 <= k[0] < 24 and k[0] % 4 == 0 and k[1] == 5}


def test_flat_raster(spark, tmp_path):
    probe.registered(spark)
    values = np.arange(24, dtype=">i2")
    (tmp_path / "x.bin").write_bytes(b"head" + values.tobytes())
    df = spark.read.format("flatraster").options(rows=3, cols=4, element="int16", offset=4, bigendian="true").load(str(tmp_path / "x.bin"))
    assert [(x.re, x.im) for x in df.orderBy("r", "c").collect()] == [(2.0 * k, 2.0 * k + 1) for k in range(12)]


def test_sniffing(spark, tmp_path):
    files = {
        "a.sio": struct.pack("<5I", sio.MAGIC, 1, 1, 13, 8),
        "b.tif": b"II*\0rest",
        "c.cos": bytes(28) + b"CSAR",
        "d.cphd": b"CPHD/1.0.1\n",
        "e.ntf": b"NITF02.10" + b" " * 100 + b"<SICD xmlns='x'>",
        "f.ntf": b"NITF02.10" + b" " * 100,
        "g.txt": b"nothing",
        "h.xml": b"<?xml version='1.0'?><safe>SENTINEL-1 product SLC</safe>",
        "i.gff": b"GSATIMG.",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {x.path.rsplit("/", 1)[1]: x.format for x in probe.sniffed(spark, str(tmp_path)).collect()}
    assert got == {"a.sio": "sio", "b.tif": "tiff", "c.cos": "cosar", "d.cphd": "cphd", "e.ntf": "sicd", "f.ntf": "nitf", "g.txt": None, "h.xml": "sentinel1", "i.gff": "gff"}


def test_fixed_width(spark, tmp_path):
    head = "".join(v.ljust(w) for (_, w), v in zip(probe.NITF_HEADER, ["NITF02.10", "03", "BF01", "me", "20200101", "a title"] + [""] * 8 + ["400", "388", "1"], strict=True))
    (tmp_path / "x.ntf").write_bytes(head.encode())
    row = probe.nitf_headers(spark, str(tmp_path)).first()
    assert (row.profile, row.title, row.images) == ("NITF02.10", "a title", "1")
    text = spark.createDataFrame([("05" + "00003" + "00100" + "---" + "   " + " " * 16 + "N".ljust(21) * 4,)], "raw string")
    block = text.select(*probe.extension(F.col("raw"), "BLOCKA")).first()
    assert (block.block, block.lines, block.layover, block.frlc) == (5.0, 100.0, None, "N")
    assert spark.range(1).select(probe.written_field(F.lit(7), 4, True), probe.written_field(F.lit("ab"), 4)).first() == ("0007", "ab  ")


def dted(elevations: np.ndarray) -> bytes:
    n_lon, n_lat = elevations.shape
    head = b"UHL1" + b"0100000E" + b"0450000N" + b"0300" + b"0300" + b"0001" + b"U  " + bytes(12) + f"{n_lon:04d}{n_lat:04d}".encode()
    out = head.ljust(80) + bytes(648 + 2700)
    for k, column in enumerate(elevations):
        stored = np.where(column < 0, 0x8000 | -column, column).astype(">u2").tobytes()
        out += struct.pack(">B3sHH", 0xAA, k.to_bytes(3, "big"), k, 0) + stored + bytes(4)
    return out


def test_elevation_cells(spark, tmp_path):
    values = np.array([[10, -1, -300], [255, 256, -32767]])
    (tmp_path / "n45.dt0").write_bytes(dted(values))
    got = {(round(x.lon, 4), round(x.lat, 4)): (x.elev, x.clamped) for x in terrain.read_dted(spark, str(tmp_path)).collect()}
    step = round(300 / 36000, 4)
    assert got[10.0, 45.0] == (10.0, False) and got[10.0, 45 + step] == (-1.0, False)
    assert got[10.0, round(45 + 600 / 36000, 4)] == (-50.0, True) and got[10 + step, 45.0] == (255.0, False)
    assert terrain.read_dted(spark, str(tmp_path), north=45.001).count() == 2
    assert terrain.cells_within(44.5, -0.5, 45.5, 0.5) == ["w001/n44", "e000/n44", "w001/n45", "e000/n45"]


def test_coast(spark, tmp_path):
    def polygon(level, area, points):
        return struct.pack(">11i", 0, len(points), level, 0, 0, 0, 0, area, 0, 0, -1) + b"".join(struct.pack(">2i", int(x * 1e6), int(y * 1e6)) for x, y in points)

    (tmp_path / "coast.b").write_bytes(polygon(1, 500, [(359.0, 1.0), (2.0, 3.0)]) + polygon(2, 900, [(5.0, 5.0)]) + polygon(1, 5, [(6.0, 6.0)]))
    rows = terrain.read_coast(spark, str(tmp_path), least_area=1.0).collect()
    assert [(x.polygon_id, x.seq, x.lon, x.lat, x.area_km2) for x in rows] == [(0, 0, -1.0, 1.0, 50.0), (0, 1, 2.0, 3.0, 50.0)]


def test_geoid(spark, tmp_path):
    grid = np.arange(5 * 8, dtype="<f4").reshape(5, 8)
    marked = b"".join(struct.pack("<i", 32) + row.tobytes() + struct.pack("<i", 32) for row in grid)
    (tmp_path / "geoid").write_bytes(marked)
    geoid = terrain.read_geoid(spark, str(tmp_path))
    assert geoid.select("step").first()[0] == 45.0
    points = spark.createDataFrame([(1, 90.0, 0.0, 5.0), (2, 45.0, -45.0, 0.0)], "id int, lat double, lon double, elev double")
    got = {x.id: x.hae for x in terrain.above_ellipsoid(points, geoid, 45.0).collect()}
    assert got == {1: 5.0, 2: 15.0}


def test_kml(spark, tmp_path):
    catalog.write_kml(views.collects(spark, SF).limit(5), str(tmp_path / "kml"))
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "kml")).collect())
    assert text.count("<Placemark>") == 5 and "</kml>" in text


def test_listing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.ntf", "y.nitf", "z.txt"):
        (tmp_path / name).write_bytes(b"abc")
    got = catalog.list_files(spark, str(tmp_path), [".ntf", ".nitf"]).collect()
    assert sorted(x.path.rsplit("/", 1)[1] for x in got) == ["x.ntf", "y.nitf"]


def test_growing_image_equals_the_whole(spark, tmp_path):
    signals = collects._signals(spark, SF, (6378137.0, 8.0, -12.0)).where("vec < 60")
    for k in range(3):
        signals.where(f"vec % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "pulses"))
    pixels = [(r, c, 6378137.0, c * 4.0, r * 4.0) for r in range(4) for c in range(4)]
    stream = integrate.pulse_stream(spark, str(tmp_path / "pulses"), signals.schema)
    query = integrate.growing_image(stream, pixels).writeStream.outputMode("complete").format("memory").queryName("growing").start()
    query.processAllAvailable()
    query.stop()
    whole = {(x.r, x.c): (x.re, x.im) for x in integrate.growing_image(signals, pixels).collect()}
    grown = {(x.r, x.c): (x.re, x.im) for x in spark.table("growing").collect()}
    assert whole.keys() == grown.keys() and all(np.allclose(whole[k], grown[k]) for k in whole)
