"""Files of tiles: what is read, and what it means."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

from echofield.sources import blocks, hdf5, hdf5_files, nitf, opened, probe, tiles
from echofield.sources.patches import block_patches, write_patches


@pytest.fixture(scope="module")
def image() -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.round(rng.normal(0, 900, (53, 37))) + 1j * np.round(rng.normal(0, 900, (53, 37)))


@pytest.fixture(scope="module")
def px(spark, image):
    rows = [(r, c, float(image[r, c].real), float(image[r, c].imag)) for r in range(53) for c in range(37)]
    return spark.createDataFrame(rows, "r long, c long, re double, im double").repartition(3).persist()


@pytest.fixture
def counted(monkeypatch):
    """Bytes that are read of files."""
    read = []
    plain = blocks.read_bytes

    def counting(path, offset, length):
        raw = plain(path, offset, length)
        read.append(len(raw))
        return raw

    monkeypatch.setattr(blocks, "read_bytes", counting)
    return read


def local(reader, *filters) -> dict:
    """What a reader gives with filters, in this process."""
    assert not list(reader.pushFilters(list(filters)))
    return {(x["image"], x["band"], x["r"], x["c"]): complex(x["re"], x["im"]) for part in reader.partitions() for batch in reader.read(part) for x in batch.to_pylist()}


def window(r, c):
    return [GreaterThanOrEqual(("r",), r[0]), LessThanOrEqual(("r",), r[1]), GreaterThanOrEqual(("c",), c[0]), LessThanOrEqual(("c",), c[1])]


def blocked(px, path, interleave: str = "pixel"):
    lines, samples = 10, 8
    size = lines * samples * 16
    write_patches(block_patches(px, 53, 37, (lines, samples), "<f8", (F.col("i") * 5 + F.col("j")) * size), path, 30 * size)
    return tiles.Image(0, 53, 37, lines, samples, "<f8")


def test_one_block_is_read_for_a_window_within_it(px, tmp_path, image, counted):
    path = str(tmp_path / "x")
    whole = blocked(px, path)
    found = local(tiles.BlockedReader(path, whole, 0, {}), *window((20, 29), (16, 23)))
    assert found == {(0, 0, r, c): image[r, c] for r in range(20, 30) for c in range(16, 24)}
    assert counted == [10 * 8 * 16]
    counted.clear()
    # Two lines of it.
    assert len(local(tiles.BlockedReader(path, whole, 0, {}), *window((23, 24), (17, 17)))) == 2
    assert sum(counted) == 2 * 8 * 16


def test_last_blocks_strides_and_turns(px, tmp_path, image):
    path = str(tmp_path / "x")
    whole = blocked(px, path)
    assert local(tiles.BlockedReader(path, whole, 0, {"rowstride": "3", "colstride": "5"})) == {(0, 0, r, c): image[r, c] for r in range(0, 53, 3) for c in range(0, 37, 5)}
    for turn in [(a, b, c) for a in (False, True) for b in (False, True) for c in (False, True)]:
        stored = image[:: -1 if turn[0] else 1, :: -1 if turn[1] else 1]
        shown = stored.T if turn[2] else stored
        rows, cols = (3, 9), (30, 34)
        found = local(tiles.BlockedReader(path, tiles.turned(whole, turn), 0, {"rowstride": "2"}), *window(rows, cols))
        assert found == {(0, 0, r, c): shown[r, c] for r in range(4, 10, 2) for c in range(30, 35)}


def test_equal_bounds_and_nothing_left(px, tmp_path, image):
    path = str(tmp_path / "x")
    whole = blocked(px, path)
    assert local(tiles.BlockedReader(path, whole, 0, {}), EqualTo(("r",), 52), EqualTo(("c",), 36)) == {(0, 0, 52, 36): image[52, 36]}
    assert not tiles.BlockedReader(path, whole, 0, {}).partitions() == []
    reader = tiles.BlockedReader(path, whole, 0, {})
    list(reader.pushFilters([GreaterThanOrEqual(("r",), 53)]))
    assert reader.partitions() == []


MODES = [("P", None), ("P", (16, 10)), ("R", (16, 10)), ("B", (53, 37)), ("B", (20, 37)), ("S", (16, 10))]


@pytest.mark.parametrize(("mode", "block"), MODES)
def test_nitf_interleaves(spark, px, tmp_path, image, mode, block):
    path = str(tmp_path / "x.ntf")
    kinds = [nitf.Written(53, 37, "SI", 16, mode=mode, block=block), nitf.Written(53, 37, "R", 64, ("I", "Q", "I", "Q"), mode, block, planes=("re", "im", "im", "re"))]
    nitf.write_nitf([(px, k) for k in kinds], path)
    found = local(nitf.NitfReader(path, {"oriented": "false"}), *window((10, 40), (5, 30)))
    swapped = image.imag + 1j * image.real
    want = {(k, b, r, c): v[r, c] for k, b, v in ((0, 0, image), (1, 0, image), (1, 1, swapped)) for r in range(10, 41) for c in range(5, 31)}
    assert found == want
    assert opened.format_of(path) == "nitf"
    assert opened.open_reader(spark, path).where("image = 1 and band = 1").count() == image.size


def masked(path: str) -> dict:
    """A file of one image in 2 x 2 blocks, of which one is not stored and the others stand in another order."""
    w = nitf.Written(4, 4, "INT", 8, ("",), "B", (2, 2), planes=("re",))
    sub = w.subheader(0).replace(b"0NC1", b"0NM1")
    table = struct.pack(">IHHH", 10 + 16, 4, 0, 0) + struct.pack(">4I", 8, 4, 0xFFFFFFFF, 0)
    data = bytes(range(12))
    counts = b"001" + nitf.digits(len(sub), 6) + nitf.digits(len(table) + 12, 10) + b"000" * 5 + b"00000" * 2
    start = nitf.text("NITF02.10", 9) + b" " * 333
    raw = start + nitf.digits(0, 12) + nitf.digits(360 + len(counts), 6) + counts + sub + table + data
    with open(path, "wb") as f:
        f.write(raw)
    firsts = {(0, 0): 8, (0, 1): 4, (1, 1): 0}
    return {(0, 0, 2 * i + r, 2 * j + c): complex(n + 2 * r + c) for (i, j), n in firsts.items() for r in range(2) for c in range(2)}


def test_masked_blocks(tmp_path):
    path = str(tmp_path / "x.ntf")
    want = masked(path)
    assert local(nitf.NitfReader(path, {"oriented": "false"})) == want


def test_magnitudes_are_remapped():
    planes = np.array([[[0, 8, 100, 200]], [[0, 64, 128, 192]]], np.uint8)
    for remap, want in {
        "NS": [0, 8, 100, 200],
        "LINM": [0, 4, 50, 100],
        "LINP": [0, 2, 50**0.5, 10],
        "LOGM": [32767 ** (x / 255) for x in (0, 8, 100, 200)],
        "LLM": [0, 4, 50, 128 ** (200 / 128) / 2],
    }.items():
        re, im = tiles.PIXELS["polar"](planes, 0, 256.0, remap, 2.0, 128.0)
        assert np.allclose(re + 1j * im, np.array([want]) * np.array([1, 1j, -1, -1j]))
    with pytest.raises(ValueError):
        tiles.PIXELS["polar"](planes, 0, 256.0, "OTHER", 1.0, 1.0)


def test_tables_of_two_parts_and_three():
    lut = lambda *t: {"ISUBCAT": "", "NLUTS": len(t), "tables": [{"LUTD": bytes(x)} for x in t]}
    f = {"PVTYPE": "INT", "NBPP": 8, "IC": "NC", "bands": [lut([1, 2], [3, 4])], "extensions": {}}
    assert nitf._pixels(f)[1:] == (("table", ((259, 516),)), 1, 1)
    f["bands"] = [lut([1, 2], [3, 4], [5, 6])]
    assert nitf._pixels(f)[1:] == (("table", ((1, 2), (3, 4), (5, 6))), 3, 1)
    f["IC"] = "C8"
    with pytest.raises(ValueError):
        nitf._pixels(f)


def test_conditional_and_repeated_fields():
    grammar = [("A", 1, "number"), ("if", lambda h: h["A"] > 1, [("B", 2, "text")]), ("each", "A", [("N", 1, "number"), ("X", "N", "bytes")]), ("rest", ("A", 1), "bytes")]
    assert nitf.parsed(b"2hi1a2bcZ", grammar) == ({"A": 2, "B": "hi", "each": [{"N": 1, "X": b"a"}, {"N": 2, "X": b"bc"}], "rest": b"Z"}, 9)
    assert nitf.parsed(b"0", [*grammar[:3]]) == ({"A": 0, "each": []}, 1)


def test_corners_move_the_fields_behind_them():
    w = nitf.Written(4, 4)
    plain = w.subheader(0)
    # ICORDS stands behind 371 bytes; with it come 60 of corners.
    moved = plain[:371] + b"G" + b"1" * 60 + plain[372:]
    a, b = (nitf.parsed(x, nitf.SUBHEADERS["02.10"])[0] for x in (plain, moved))
    assert b.pop("IGEOLO") == "1" * 60 and b.pop("ICORDS") == "G" and a.pop("ICORDS") == ""
    assert a == b and a["NBPP"] == 32


# HDF5


def chunked(spark, px, path, **options):
    tree = {"a": {"b": {"slc": hdf5_files.Raster(px, 53, 37, options.pop("chunk", (8, 4)), planes=("re", "im"), **options)}}, "n": 7, "t": "text", "list": ["x", "yy"], "values": np.arange(6.0).reshape(2, 3)}
    hdf5_files.write_hdf5(spark, tree, path, {"who": "me", "many": np.array([1, 2], "<i4")})


@pytest.mark.parametrize("options", [{"deflated": True}, {"deflated": False}, {"compound": True}, {"compound": True, "element": ">f8", "chunk": (3, 2)}, {"element": "<i2", "chunk": (60, 40)}])
def test_hdf5_chunks(spark, px, tmp_path, image, options):
    path = str(tmp_path / "x.h5")
    chunked(spark, px, path, **options)
    found = local(hdf5.HdfReader(path, {"dataset": "/a/b/slc"}), *window((9, 31), (4, 20)))
    assert found == {(0, 0, r, c): image[r, c] for r in range(9, 32) for c in range(4, 21)}
    assert len(local(hdf5.HdfReader(path, {"dataset": "/a/b/slc"}))) == image.size


def test_hdf5_values_and_attributes(spark, px, tmp_path):
    path = str(tmp_path / "x.h5")
    chunked(spark, px, path)
    f = hdf5.File(path)
    assert (f.value("n"), f.value("t"), f.value("/list")) == (7, "text", ["x", "yy"])
    assert f.value("values").tolist() == [[0, 1, 2], [3, 4, 5]]
    found = f.attributes()
    assert found["who"] == "me" and found["many"].tolist() == [1, 2]
    assert f.find("a/none") is None and f.product is None
    with pytest.raises(ValueError):
        f.dataset("none")
    rows = hdf5.scalars(spark.createDataFrame([(path,)], "path string"), ["n", "t", "missing"]).collect()
    assert {(x["name"], tuple(x["texts"] or ()), tuple(x["numbers"] or ())) for x in rows} == {("n", (), (7.0,)), ("t", ("text",), ())}


def test_a_window_prunes_chunks_and_nodes_of_the_tree(spark, px, tmp_path, counted):
    path = str(tmp_path / "x.h5")
    chunked(spark, px, path, deflated=False, chunk=(2, 2))  # 27 x 19 chunks: a tree of two levels
    counted.clear()
    d = hdf5.File(path).dataset("/a/b/slc")
    counted.clear()
    every = d.chunks(0, 52)
    whole = sum(counted)
    counted.clear()
    some = d.chunks(20, 21)
    assert len(every) == 27 * 19 and {k[0] for k in some} == {20} and sum(counted) < whole / 2
    reader = hdf5.HdfReader(path, {"dataset": "/a/b/slc"})
    list(reader.pushFilters(window((20, 21), (6, 7))))
    (part,) = reader.partitions()
    counted.clear()
    assert sum(b.num_rows for b in reader.read(part)) == 4 and counted == [2 * 2 * 2 * 4]


def modern(path: str, layout: bytes, body: bytes, filters: bytes = b"") -> None:
    """A file of the later generation: a root group with one link to a dataset of 4 x 6 shorts."""
    body_at, data_at, root_at = 256, 1024, 512

    def header(messages: list[tuple[int, bytes]]) -> bytes:
        raw = b"".join(struct.pack("<BHB", kind, len(m), 0) + m for kind, m in messages)
        return b"OHDR" + struct.pack("<BBH", 2, 1, len(raw)) + raw + bytes(4)

    space = struct.pack("<BBBBQQ", 2, 2, 0, 1, 4, 6)
    data = header([(1, space), (3, hdf5_files._type("<i2")), (8, layout), *([(11, filters)] if filters else [])])
    link = struct.pack("<BBB", 1, 0, 1) + b"d" + struct.pack("<Q", body_at)
    root = header([(2, struct.pack("<BBQQ", 0, 0, 2**64 - 1, 2**64 - 1)), (6, link)])
    start = hdf5.SIGNATURE + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, 2**64 - 1, 0, root_at) + bytes(4)
    raw = bytearray(data_at + len(body))
    for at, part in ((0, start), (body_at, data), (root_at, root), (data_at, body)):
        raw[at : at + len(part)] = part
    with open(path, "wb") as f:
        f.write(raw)


def test_hdf5_of_the_later_generation(tmp_path):
    path = str(tmp_path / "x.h5")
    values = np.arange(24, dtype="<i2").reshape(4, 6)
    cut = np.stack([values[:2, :4], np.pad(values[:2, 4:], ((0, 0), (0, 2))), values[2:, :4], np.pad(values[2:, 4:], ((0, 0), (0, 2)))])
    single = struct.pack("<BBBBB3HB", 4, 2, 0, 3, 2, 4, 6, 2, 1) + struct.pack("<Q", 1024)
    implicit = struct.pack("<BBBBB3HB", 4, 2, 0, 3, 2, 2, 4, 2, 2) + struct.pack("<Q", 1024)
    fixed = struct.pack("<BBBBB3HBB", 4, 2, 0, 3, 2, 2, 4, 2, 3, 10) + struct.pack("<Q", 1024)
    array = b"FAHD" + struct.pack("<BBBBQQI", 0, 0, 8, 10, 4, 1024 + 64, 0)
    places = b"FADB" + struct.pack("<BBQ", 0, 0, 1024) + struct.pack("<4Q", *(1200 + 16 * k for k in range(4)))
    compact = struct.pack("<BBH", 3, 0, 48) + values.tobytes()
    contiguous = struct.pack("<BBQQ", 3, 1, 1024, 48)
    want = {(0, 0, r, c): complex(values[r, c]) for r in range(4) for c in range(6)}
    body = (array.ljust(64, b"\0") + places).ljust(176, b"\0") + cut.tobytes()
    for layout, data in ((single, values.tobytes()), (implicit, cut.tobytes()), (fixed, body), (contiguous, values.tobytes())):
        modern(path, layout, data)
        assert local(hdf5.HdfReader(path, {"dataset": "d"})) == want
        assert hdf5.File(path).value("d").tolist() == values.tolist()
    modern(path, compact, b"")
    assert hdf5.File(path).value("d").tolist() == values.tolist()


def test_chunks_that_are_not_stored_are_zeros(tmp_path):
    path = str(tmp_path / "x.h5")
    places = b"FADB" + struct.pack("<BBQ", 0, 0, 1024) + struct.pack("<4Q", 1200, *(2**64 - 1,) * 3)
    array = b"FAHD" + struct.pack("<BBBBQQI", 0, 0, 8, 10, 4, 1024 + 64, 0)
    fixed = struct.pack("<BBBBB3HBB", 4, 2, 0, 3, 2, 2, 4, 2, 3, 10) + struct.pack("<Q", 1024)
    modern(path, fixed, (array.ljust(64, b"\0") + places).ljust(176, b"\0") + np.full(8, 9, "<i2").tobytes())
    found = local(hdf5.HdfReader(path, {"dataset": "d"}))
    assert len(found) == 24 and all(v == (9 if r < 2 and c < 4 else 0) for (_, _, r, c), v in found.items())


def test_products_are_told_apart(spark, px, tmp_path):
    path = str(tmp_path / "ice.h5")
    raster = lambda p: hdf5_files.Raster(px, 53, 37, (20, 20), planes=(p,))
    hdf5_files.write_hdf5(spark, {"s_i": raster("re"), "s_q": raster("im"), "look_side": "left"}, path)
    other = str(tmp_path / "other.h5")
    chunked(spark, px, other)
    (tmp_path / "none").write_bytes(b"nothing of the kind")
    found = {x["path"].rsplit("/")[-1]: x["format"] for x in probe.sniffed(spark, str(tmp_path)).collect()}
    assert found == {"ice.h5": "iceye", "other.h5": None, "none": None}
    assert opened.format_of(path) == "hdf5raster" and opened.format_of(other) is None
    assert opened.open_reader(spark, path).count() == 53 * 37
