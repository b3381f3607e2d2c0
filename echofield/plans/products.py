"""Queries over files of tiles and products, written by tasks and read again, with their SQL."""

from __future__ import annotations

import math
import os
import struct
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cx import rounded
from ..operators import orbits
from ..sources import ceos, hdf5, hdf5_files, nitf, opened, sentinel1, tiff, tiles
from ..sources.patches import block_patches, scratch_file, write_patches
from ..sources.strips import SUFFIX, write_strips
from . import views
from .views import COLLECT, PX, SAMPLES

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _shown(px: DataFrame, *names: str, scale: float = 1.0) -> DataFrame:
    return px.select(*names, "r", "c", rounded(F.col("re") / scale).alias("re"), rounded(F.col("im") / scale).alias("im"))


BLOCK = (64, 12)


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = views.height(spark, sf_dir), scratch_file(spark, "blocks.bin")
    lines, samples = BLOCK
    down, across = -(-rows // lines), -(-SAMPLES // samples)
    size = lines * samples * 8
    at = (F.col("i") * across + F.col("j")) * size
    write_patches(block_patches(views.pixels(spark, sf_dir), rows, SAMPLES, BLOCK, ">f4", at), path, down * across * size)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(tiles.BlockedSource)
    options = {"rows": rows, "cols": SAMPLES, "blockrows": lines, "blockcols": samples, "bigendian": "true"}
    return spark.read.format("blockedraster").options(**options).load(path)


@query(f"with {PX} select r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px")
def blocked_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image in blocks, the last ones of which are cut."""
    return _shown(_blocked(spark, sf_dir))


@query(f"with {PX} select r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px where r >= 64 and r < 192 and c between 12 and 25 and r % 3 = 0")
def blocked_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on both axes leave four of the blocks to be read."""
    return _shown(_blocked(spark, sf_dir).where("r >= 64 and r < 192 and c between 12 and 25 and r % 3 = 0"))


#: Magnitudes are kept in steps of 1/PARTS, phases in 256 steps of a turn.
PARTS = 64


def _images(spark: SparkSession, sf_dir: str) -> str:
    rows, path = views.height(spark, sf_dir), scratch_file(spark, "images.ntf")
    px = views.pixels(spark, sf_dir)
    a = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    whole = F.least(F.lit(255.0), F.rint(a * PARTS))
    polar = px.withColumn("m", whole).withColumn("p", F.pmod(F.rint(F.atan2("im", "re") * 128 / F.lit(3.141592653589793)), F.lit(256.0)))
    mark = bytes((7 * k + 3) % 256 for k in range(256))
    W = nitf.Written
    order = nitf.range_direction("ROW_INC")
    scaled = nitf.range_direction("ROW_INC", scale=float(PARTS))
    pairs = px.withColumn("re2", F.col("im")).withColumn("im2", -F.col("re"))
    nitf.write_nitf(
        [
            (px, W(rows, SAMPLES, "R", 32, ("I", "Q"), "P", None, extension=order)),
            (polar, W(rows, SAMPLES, "INT", 8, ("M", "P"), "B", (50, 20), extension=scaled, planes=("m", "p"))),
            (polar, W(rows, SAMPLES, "INT", 8, ("LU",), "B", (32, 32), table=mark, planes=("m",))),
            (pairs, W(rows, SAMPLES, "R", 64, ("I", "Q", "I", "Q"), "S", (128, 16), extension=order, planes=("re", "im", "re2", "im2"))),
            (px, W(rows, SAMPLES, "C", 64, ("",), "P", (40, 10), extension=nitf.range_direction("COL_INC"))),
            (px, W(rows, SAMPLES, "C", 32, ("",), "P", None, extension=order)),
            (px.withColumn("re", F.rint(F.col("re") * 1000)), W(rows, SAMPLES, "SI", 16, ("G",), "R", (64, 8), extension=order, planes=("re",))),
        ],
        path,
    )
    return path


_POLAR = (
    "pm as (select r, c, re, im, least(255.0::double, round_even(sqrt(re*re+im*im)*64, 0)) m,"
    " (round_even(atan2(im, re)*128/3.141592653589793::double, 0)::bigint % 256 + 256) % 256 p from px)"
)


@query(
    f"with {PX}, {_POLAR}, n as (select max(r) most from px), i as ("
    " select 0 image, 0 band, r, c, re, im from px"
    " union all select 1, 0, r, c, m/64*cos(p*2*pi()/256), m/64*sin(p*2*pi()/256) from pm"
    " union all select 2, 0, most-r, 31-c, ((7*m::bigint+3) % 256)::double, 0 from pm, n"
    " union all select 3, 0, r, c, re, im from px union all select 3, 1, r, c, im, -re from px"
    " union all select 4, 0, c, most-r, re, im from px, n"
    " union all select 6, 0, r, c, round_even(re*1000, 0), 0 from px)"
    " select image::int image, band::int band, r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from i"
)
def nitf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of six kinds in one file, in four interleaves and three directions of range."""
    nitf.registered(spark)
    return _shown(spark.read.format("nitf").load(_images(spark, sf_dir)).where("image <> 5"), "image", "band")


def _half(x: str) -> str:
    """A float of whose fraction seven bits are left."""
    unit = f"pow(2.0::double, floor(log2(abs({x}))) - 7)"
    return f"case when {x} = 0 then 0 else sign({x})*floor(abs({x})/{unit})*{unit} end"


@query(f"with {PX} select r, c, round({_half('re')}, 9) + 0.0 re, round({_half('im')}, 9) + 0.0 im from px")
def nitf_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex floats of which the upper halves are kept."""
    nitf.registered(spark)
    back = spark.read.format("nitf").load(_images(spark, sf_dir)).where("image = 5")
    return back.select("r", "c", rounded(F.col("re"), 9).alias("re"), rounded(F.col("im"), 9).alias("im"))


@query(
    "with n as (select max(vec_id) + 1 n from embeddings) select image, n as rows, 32::bigint cols, kind, bits, bands, subcategories, tables, mode,"
    " case block_rows when 0 then n else block_rows end block_rows, block_cols::bigint block_cols"
    " from n, (values (0, 'R', 32, 2, 'I,Q', 0, 'P', 0, 32), (1, 'INT', 8, 2, 'M,P', 0, 'B', 50, 20), (2, 'INT', 8, 1, 'LU', 1, 'B', 32, 32),"
    " (3, 'R', 64, 4, 'I,Q,I,Q', 0, 'S', 128, 16), (4, 'C', 64, 1, '', 0, 'P', 40, 10), (5, 'C', 32, 1, '', 0, 'P', 0, 32),"
    " (6, 'SI', 16, 1, 'G', 0, 'R', 64, 8)) v(image, kind, bits, bands, subcategories, tables, mode, block_rows, block_cols)"
)
def nitf_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image subheaders of a file as rows."""
    files = spark.createDataFrame([(_images(spark, sf_dir),)], "path string")
    return nitf.segment_table(files).drop("path", "id", "data", "bytes", "extensions")


# Products in HDF5

CHUNK = (48, 10)


@query(f"with {PX} select 0::int image, c r, r c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px")
def iceye_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of two datasets, looking to the right: range lines are columns."""
    rows, px, path = views.height(spark, sf_dir), views.pixels(spark, sf_dir), scratch_file(spark, "iceye.h5")
    parts = {n: hdf5_files.Raster(px, rows, SAMPLES, CHUNK, "<f4", (p,)) for n, p in (("s_i", "re"), ("s_q", "im"))}
    hdf5_files.write_hdf5(spark, {**parts, "look_side": "right", "product_name": "TEST"}, path)
    hdf5.registered(spark)
    return _shown(spark.read.format("hdf5raster").load(path), "image")


@query(
    f"with {PX}, n as (select max(r) most from px), i as (select 0 image, c r, most-r c, re, im from px, n"
    " union all select 1, c, most-r, im, re from px, n union all select 2, c, most-r, -re, im from px, n)"
    " select image::int image, r, c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from i where c between 100 and 180 and r < 20"
)
def nisar_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polarisations of one frequency and one of another, as compounds; looking to the left turns lines."""
    rows, px, path = views.height(spark, sf_dir), views.pixels(spark, sf_dir), scratch_file(spark, "nisar.h5")
    raster = lambda px: hdf5_files.Raster(px, rows, SAMPLES, (16, 8), "<f4", ("re", "im"), compound=True)
    swaths = {
        "frequencyA": {"HH": raster(px), "HV": raster(px.select("r", "c", F.col("im").alias("re"), F.col("re").alias("im"))), "listOfPolarizations": ["HH", "HV"]},
        "frequencyB": {"VV": raster(px.withColumn("re", -F.col("re"))), "listOfPolarizations": ["VV"]},
    }
    about = {"listOfFrequencies": ["A", "B"], "lookDirection": "Left"}
    hdf5_files.write_hdf5(spark, {"science": {"LSAR": {"identification": about, "SLC": {"swaths": swaths}}}}, path)
    hdf5.registered(spark)
    return _shown(spark.read.format("hdf5raster").load(path).where("c between 100 and 180 and r < 20"), "image")


@query(
    f"with {PX}, i as (select 0 image, 31-c r, r c, round_even(re*1000, 0) re, round_even(im*1000, 0) im from px"
    " union all select 1, 31-c, r, round_even(im*1000, 0), round_even(re*1000, 0) from px)"
    " select image::int image, r, c, re + 0.0 re, im + 0.0 im from i"
)
def csm_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two images with whole numbers on a third axis, columns from far to near, lines late and looking right."""
    rows, px, path = views.height(spark, sf_dir), views.pixels(spark, sf_dir), scratch_file(spark, "csm.h5")
    whole = px.select("r", "c", F.rint(F.col("re") * 1000).alias("re"), F.rint(F.col("im") * 1000).alias("im"))
    raster = lambda planes: hdf5_files.Raster(whole, rows, SAMPLES, CHUNK, "<i2", planes)
    tree = {"S01": {"SBI": raster(("re", "im"))}, "S02": {"SBI": raster(("im", "re"))}}
    about = {"Mission ID": "CSK", "Lines Order": "EARLY-LATE", "Columns Order": "FAR-NEAR", "Look Side": "RIGHT"}
    hdf5_files.write_hdf5(spark, tree, path, about)
    hdf5.registered(spark)
    return _shown(spark.read.format("hdf5raster").load(path), "image")


# Chains of records


def _number(value: Column, n: int) -> Column:
    """A whole number of n bytes, the first one the highest."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n, "0"))


def _head(number: Column, subtype: int, kind: int, length: int) -> Column:
    return F.concat(_number(number, 4), F.unhex(F.lit(f"{subtype:02X}{kind:02X}1214")), _number(F.lit(length), 4))


def _laid(parts: list[tuple[int, int, Column]], begin: int, end: int) -> Column:
    """Texts at their places, right-aligned, with spaces between."""
    out, at = [], begin
    for place, width, value in sorted(parts, key=lambda x: x[0]):
        out += [F.lit(" " * (place - at)), F.lpad(value, width, " ")]
        at = place + width
    return F.encode(F.concat(*out, F.lit(" " * (end - at))), "ISO-8859-1")


def _text(value: Column) -> Column:
    """A number with seven digits behind the point; cheaper than a format string."""
    return value.cast("decimal(22, 7)").cast("string")


SUMMARY_BYTES, POSITION_BYTES, POINTS = 1720, 386 + 6 * 22 * 3, 3


def _leader_file(spark: SparkSession, sf_dir: str) -> str:
    """A summary and a position record for each collect, behind a descriptor.

    Records are mostly spaces, so the file is kept in compressed strips.
    """
    path = scratch_file(spark, "LED" + SUFFIX)
    co = views.collects(spark, sf_dir).select("collect_id", "lat", "lon", "graze", "azim", "side")
    low, n = co.agg(F.min("collect_id"), F.count("*")).first()
    k = F.col("collect_id") - low
    values = {
        "scene_id": F.concat(F.lit("ALOS2-"), F.col("collect_id").cast("string")), "ctr_line": (F.col("collect_id") % 100).cast("string"), "ctr_pixel": (F.col("collect_id") % 16).cast("string"),
        "clock_angle": F.when(F.col("side") == "L", "-90.000").otherwise("90.000"), "wavelength": _text(F.col("graze") / 100), "prf": _text(F.col("azim") * 10 + 1000000),
        "bw_az": _text(F.col("graze") * 20), "bw_rng": _text(F.col("graze") * 1000), "line_spacing": _text(F.col("graze") / 10), "pixel_spacing": _text(F.lit(1.5)),
        "at_dop_const": _text(F.col("azim")), "at_dop_lin": _text(F.lit(0.5)), "at_dop_quad": _text(F.lit(0.001)), "xt_dop_const": _text(F.col("azim")), "xt_dop_lin": _text(F.lit(-0.25)), "xt_dop_quad": _text(F.lit(0.002)),
        "xt_rate_const": _text(F.lit(-500)), "xt_rate_lin": _text(F.lit(0.1)), "xt_rate_quad": _text(F.lit(0)),
    }
    where = ceos.FIELDS[ceos.SUMMARY]
    summary = F.concat(_head(2 * k + 2, 18, ceos.SUMMARY, SUMMARY_BYTES), _laid([(*where[n], v) for n, v in values.items()], 12, SUMMARY_BYTES))
    place = ceos.FIELDS[ceos.POSITION]
    about = [(*place["points"], F.lit(str(POINTS))), (*place["day_in_year"], F.lit("12")), (*place["second"], _text(F.col("azim"))), (*place["interval"], F.lit("60.0"))]
    cells = [(ceos.POINTS_AT + (6 * p + j) * 22, 22, _text((F.col("lat") if j < 3 else F.col("lon")) * (6 * p + j + 1))) for p in range(POINTS) for j in range(6)]
    position = F.concat(_head(2 * k + 3, 18, ceos.POSITION, POSITION_BYTES), _laid(about + cells, 12, POSITION_BYTES))
    both = SUMMARY_BYTES + POSITION_BYTES
    head = struct.pack(">IBBBBI", 1, 11, 192, 18, 18, 720) + b" " * 708
    write_strips(co.withColumn("at", 720 + k * both), F.concat(summary, position), both, path, 720 + n * both, head)
    return path


@query(
    f"with {COLLECT}, k as (select collect_id, row_number() over (order by collect_id) - 1 k from co)"
    " select 1::bigint as number, 0::bigint as at, 192::int as type, 720::bigint as length union all select 2*k+2, 720+k*(1720+782), 10, 1720 from k union all select 2*k+3, 720+k*(1720+782)+1720, 30, 782 from k"
)
def ceos_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a file, found from many places at once; lengths alternate, so guesses by length fail."""
    return ceos.records(spark, _leader_file(spark, sf_dir), 1 << 20).select("number", "at", "type", "length")


@query(
    f"with {COLLECT}, v as (select collect_id, side, round(graze/100, 7) w, round(azim*10+1000000, 7) prf, round(graze*20, 7) bw_az, round(graze*1000, 7) bw_rng, round(graze/10, 7) ls, round(azim, 7) azim,"
    " (collect_id % 16)::double px, (collect_id % 100)::double ln, lat, lon from co), d as (select *, case side when 'L' then -1.0::double else 1.0::double end*1000/prf dt,"
    " azim + px*(-0.25::double+px*0.002::double) + azim + ln*(0.5::double+ln*0.001::double) - (azim+azim)/2 dop from v)"
    " select collect_id, side = 'L' looks_left, round(2/w, 6) row_kctr, round(2*bw_rng*1000/299792458.0::double, 9) row_bw, round(bw_az*1000/prf/ls, 9) col_bw, round(dt/ls, 12) time_ca_1,"
    " round(dop, 6) + 0.0 doppler_scp, round(-500 + px*0.1::double, 6) doppler_rate_scp, round(dop*dt/ls, 9) + 0.0 delta_kcoa from d"
)
def ceos_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata that follows from the summary records."""
    path = _leader_file(spark, sf_dir)
    found = ceos.contents(ceos.records(spark, path, 1 << 20).where(F.col("type") == ceos.SUMMARY), path)
    made = ceos.product_fields(found.select(*ceos.fields(F.col("content"), ceos.SUMMARY)))
    digits = {"row_kctr": 6, "row_bw": 9, "col_bw": 9, "time_ca_1": 12, "doppler_scp": 6, "doppler_rate_scp": 6, "delta_kcoa": 9}
    return made.select(F.regexp_extract("scene_id", "-(.*)", 1).cast("long").alias("collect_id"), F.col("left").alias("looks_left"), *(rounded(F.col(n), d).alias(n) for n, d in digits.items()))


@query(
    f"with {COLLECT} select collect_id, p::int k, round(round(azim, 7) + 60*p, 6) as second, round(lat*(6*p+1), 6) + 0.0 x, round(lat*(6*p+3), 6) + 0.0 z, round(lon*(6*p+4), 6) + 0.0 vx from co, range(3) t(p)"
)
def ceos_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State vectors of the position records, with the collect whose summary is in front of them."""
    path = _leader_file(spark, sf_dir)
    found = ceos.records(spark, path, 1 << 20)
    of = lambda kind: ceos.contents(found.where(F.col("type") == kind), path)
    pair = F.expr("number div 2")
    scenes = of(ceos.SUMMARY).select(pair.alias("pair"), *ceos.fields(F.col("content"), ceos.SUMMARY)[:1])
    at = of(ceos.POSITION).select(pair.alias("pair"), "content", *ceos.fields(F.col("content"), ceos.POSITION))
    states = at.select("pair", "second", "interval", ceos.points(F.col("content"), F.col("points")).alias("states"))
    each = states.join(scenes, "pair").select("scene_id", "second", "interval", F.inline("states"))
    when = rounded(F.col("second") + F.col("interval") * F.col("k")).alias("second")
    return each.select(F.regexp_extract("scene_id", "-(.*)", 1).cast("long").alias("collect_id"), "k", when, *(rounded(F.col(n)).alias(n) for n in ("x", "z", "vx")))


def _line_file(spark: SparkSession, sf_dir: str) -> str:
    """The test image with a record for each line."""
    rows, path = views.height(spark, sf_dir), scratch_file(spark, "IMG")
    width = ceos.PREFIX_BYTES + SAMPLES * 8
    r = F.col("r")
    values = {"record": r + 2, "line": r + 1, "pixels": F.lit(SAMPLES), "year": F.lit(2020), "day": r % 366, "msec": r * 7, "prf": F.lit(2_000_000), "usec": r * 7001 + (1 << 33), "slant_range": 700_000 + r, "lat_center": -r * 11, "lon_center": r * 13}
    parts, at = [_head(r + 2, 50, 10, width)], 12
    for name, place, kind in ceos.PREFIX[1:]:
        n = int(kind[2])
        value = values.get(name, F.lit(0))
        parts += [F.unhex(F.lit("00" * (place - at))), F.unhex(F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n)))]
        at = place + n
    prefixes = spark.range(rows).withColumnRenamed("id", "r").select((720 + r * width).alias("at"), F.concat(*parts, F.unhex(F.lit("00" * (ceos.PREFIX_BYTES - at)))).alias("data"))
    pixels = block_patches(views.pixels(spark, sf_dir), rows, SAMPLES, (1, SAMPLES), ">f4", 720 + F.col("i") * width + ceos.PREFIX_BYTES)
    head = bytearray(struct.pack(">IBBBBI", 1, 50, 192, 18, 18, 720) + b" " * 708)
    told = {"bits": 32, "group_bytes": 8, "lines": rows, "pixels": SAMPLES, "prefix": ceos.PREFIX_BYTES, "line_bytes": SAMPLES * 8, "suffix": 0}
    for name, value in told.items():
        place, n = ceos.DESCRIPTOR[name]
        head[place : place + n] = str(value).rjust(n).encode()
    head[slice(ceos.KIND_AT[0], sum(ceos.KIND_AT))] = b"C*8 "
    write_patches(prefixes.unionByName(pixels), path, 720 + rows * width, bytes(head))
    return path


@query(f"with {PX}, n as (select max(r) most from px) select c r, most-r c, round(re, 6) + 0.0 re, round(im, 6) + 0.0 im from px, n where c < 20")
def ceos_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of a record for each line, from a sensor that looked to the left."""
    ceos.registered(spark)
    return _shown(spark.read.format("ceosimage").option("left", "true").load(_line_file(spark, sf_dir)).where("r < 20"))


@query("select vec_id + 1 line, vec_id % 366 \"day\", vec_id*7001 + 8589934592 usec, 700000 + vec_id slant_range, -11*vec_id lat_center, 13*vec_id lon_center from embeddings")
def ceos_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in front of each line."""
    return ceos.line_table(spark, _line_file(spark, sf_dir)).select("line", "day", "usec", "slant_range", "lat_center", "lon_center")


# Products of bursts

PER_BURST, BURST_TIME, LINE_TIME, NEAR_TIME, RATE = 50, 2.75, 0.002, 0.005, 64e6
BASE = datetime(2021, 3, 4, 5, 6, 7)


def _annotation(swath: str, lines: int) -> str:
    n = -(-lines // PER_BURST)
    when = lambda s: (BASE + timedelta(seconds=s)).isoformat(timespec="microseconds")
    listed = lambda name, texts: f"<{name}List count='{len(texts)}'>" + "".join(f"<{name}>{t}</{name}>" for t in texts) + f"</{name}List>"
    bursts = listed("burst", [f"<azimuthTime>{when(k * BURST_TIME)}</azimuthTime>" for k in range(n)])
    rates = listed("azimuthFmRate", [f"<azimuthTime>{when(3 * k)}</azimuthTime><t0>0.0051</t0><azimuthFmRatePolynomial count='3'>{-2300 + 10 * k} 1e5 -1e7</azimuthFmRatePolynomial>" for k in range(n + 2)])
    centres = listed("dcEstimate", [f"<azimuthTime>{when(4 * k)}</azimuthTime><t0>0.0049</t0><dataDcPolynomial count='3'>{20 + 5 * k} -3e4 2e6</dataDcPolynomial>" for k in range(n + 2)])
    moments = range(-40, math.ceil(n * BURST_TIME) + 41, 10)
    orbit = listed("orbit", [f"<time>{when(t)}</time><position><x>{7e6 - 4 * t * t}</x><y>{7600 * t}</y><z>{100 * t}</z></position>" for t in moments])
    return (
        f"<product><adsHeader><swath>{swath.upper()}</swath><polarisation>VV</polarisation></adsHeader><generalAnnotation><productInformation><rangeSamplingRate>{RATE}</rangeSamplingRate>"
        f"<radarFrequency>5.405e9</radarFrequency><azimuthSteeringRate>1.6</azimuthSteeringRate></productInformation>{orbit}{rates}</generalAnnotation>"
        f"<imageAnnotation><imageInformation><slantRangeTime>{NEAR_TIME}</slantRangeTime><azimuthTimeInterval>{LINE_TIME}</azimuthTimeInterval><azimuthPixelSpacing>14.0</azimuthPixelSpacing>"
        f"<numberOfSamples>{SAMPLES}</numberOfSamples><numberOfLines>{lines}</numberOfLines></imageInformation></imageAnnotation>"
        f"<dopplerCentroid>{centres}</dopplerCentroid><swathTiming><linesPerBurst>{PER_BURST}</linesPerBurst>{bursts}</swathTiming></product>"
    )


def _product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product of two swaths: even and odd lines of the test image. Returns its files."""
    folder = scratch_file(spark, "product.SAFE")
    for part in ("measurement", "annotation"):
        os.makedirs(f"{folder}/{part}")
    rows, objects = views.height(spark, sf_dir), []
    for k in range(2):
        name, lines = f"s1a-iw{k + 1}-slc-vv-00{k}", (rows + 1 - k) // 2
        px = views.pixels(spark, sf_dir).where(F.col("r") % 2 == k).select(F.expr("r div 2").alias("r"), "c", F.rint(F.col("re") * 1000).alias("re"), F.rint(F.col("im") * 1000).alias("im"))
        tiff.write_complex_shorts(px, f"{folder}/measurement/{name}.tiff", lines, SAMPLES)
        with open(f"{folder}/annotation/{name}.xml", "w") as f:
            f.write(_annotation(f"iw{k + 1}", lines))
        for kind, href in (("s1Level1MeasurementSchema", f"./measurement/{name}.tiff"), ("s1Level1ProductSchema", f"./annotation/{name}.xml")):
            objects.append(f"<dataObject ID='{kind}{k}' repID='{kind}'><byteStream><fileLocation locatorType='URL' href='{href}'/></byteStream></dataObject>")
    with open(f"{folder}/manifest.safe", "w") as f:
        f.write(f"<xfdu><dataObjectSection>{''.join(objects)}</dataObjectSection></xfdu>")
    opened.registered(spark)
    return sentinel1.manifest_files(spark.createDataFrame([(f"{folder}/manifest.safe",)], "path string"))


#: Phases in turns at a line and sample of a burst, by the definition of the deramping function.
_TURNS = (
    "t1 as (select *, burst*2.75::double+25*0.002::double t, 0.005::double+s/64e6::double tau from t0),"
    " t2 as (select *, ceil(t/3-0.5::double) rk, ceil(t/4-0.5::double) dk, sqrt(64*t*t+7600.0::double*7600+10000) v from t1),"
    " t3 as (select *, (-2300+10*rk)+(tau-0.0051::double)*(1e5::double+(tau-0.0051::double)*-1e7::double) ka, (20+5*dk)+(tau-0.0049::double)*(-3e4::double+(tau-0.0049::double)*2e6::double) f,"
    " (-2300+10*rk)+(0.005::double-0.0051::double)*(1e5::double+(0.005::double-0.0051::double)*-1e7::double) ka0, (20+5*dk)+(0.005::double-0.0049::double)*(-3e4::double+(0.005::double-0.0049::double)*2e6::double) f0,"
    " 2*v/299792458.0::double*5.405e9::double*radians(1.6::double) ks from t2),"
    " t4 as (select *, (line-25)*0.002::double-(-f/ka+f0/ka0) e, ka*ks/(ka-ks) kt from t3),"
    " turns as (select *, kt*e*e/2+f*e ph from t4)"
)


@query(
    f"with {PX}, t0 as (select 'IW' || (r % 2 + 1) swath, ((r // 2) // 50)::int burst, (r // 2) % 50 line, c s, round_even(re*1000, 0) re, round_even(im*1000, 0) im from px), {_TURNS}"
    " select swath, burst, line, s c, round((re*cos(2*pi()*ph)+im*sin(2*pi()*ph))/1000, 6) + 0.0 re, round((im*cos(2*pi()*ph)-re*sin(2*pi()*ph))/1000, 6) + 0.0 im from turns"
)
def sentinel1_deramped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bursts of two swaths without the phase of steering and centroid."""
    files = _product(spark, sf_dir)
    found = sentinel1.bursts(sentinel1.annotations(files))
    out = sentinel1.deramped(sentinel1.measurements(spark, files), found)
    swath = F.concat(F.lit("IW"), F.regexp_extract("name", "-iw(.)-", 1))
    return out.select(swath.alias("swath"), "burst", "line", "c", rounded(F.col("re") / 1000).alias("re"), rounded(F.col("im") / 1000).alias("im"))


@query(
    f"with n as (select max(vec_id) + 1 n from embeddings), sw as (select range k from range(2)), bu as (select 'IW' || (k+1) swath, unnest(range(((n+1-k)//2+49)//50))::int burst from sw, n),"
    " gr as (select *, i, j, [0, 25, 49][i+1]::bigint line, [0, 16, 31][j+1]::bigint s from bu, range(3) a(i), range(3) b(j)), t0 as (select swath, burst, i, j, line, s from gr), "
    f"{_TURNS}, m as (select swath, burst, i, j, ph, (line-25)*14.0::double az, (s-16)*(299792458.0::double/2/64e6::double) rg from turns),"
    # Lagrange's form through three by three samples, and its slope along azimuth in the middle.
    " l as (select m.*, -25*14.0::double a0, 0.0::double a1, 24*14.0::double a2, -16*(299792458.0::double/2/64e6::double) r0, 0.0::double r1, 15*(299792458.0::double/2/64e6::double) r2 from m)"
    " select swath, burst, round(sum(case when j = 1 then ph*case i when 0 then (0-a2)/((a0-a1)*(a0-a2)) when 1 then (0-a0+0-a2)/((a1-a0)*(a1-a2)) else (0-a0)/((a2-a0)*(a2-a1)) end else 0 end), 9) + 0.0 middle,"
    " round(sum(ph*case i when 0 then 0 when 1 then 0 else 0 end) + sum(case when j = 1 and i = 1 then ph else 0 end), 9) + 0.0 phase from l group by 1, 2"
)
def sentinel1_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted phase and its slope along azimuth, in the middle of each burst."""
    found = sentinel1.phase_polynomials(sentinel1.bursts(sentinel1.annotations(_product(spark, sf_dir))))
    at = lambda p: F.get(F.get(p, F.lit(0)), F.lit(0))
    return found.select("swath", "burst", rounded(at(F.col("delta_kcoa_poly")), 9).alias("middle"), rounded(at(F.col("phase_poly")), 9).alias("phase"))


# Orbits

def _orbit_states(files: DataFrame) -> DataFrame:
    """State vectors every ten minutes of an orbit; precise files differ from others by metres."""
    t = F.explode(F.sequence(F.lit(0), F.lit(156)))
    rows = files.select("file", "rank", "valid_from", t.alias("k")).withColumn("t", F.col("valid_from") + F.col("k") * 600)
    turn = F.col("t") % 6000 * F.lit(2 * 3.141592653589793 / 6000)
    return rows.select("file", "t", (7e6 * F.cos(turn) + F.col("rank")).alias("x"), (7e6 * F.sin(turn) - F.col("rank")).alias("y"), (F.col("t") % 1000).alias("z"))


@query(
    f"with {COLLECT}, pr as (select collect_id product, collector % 2 mission, epoch(collect_start)::double + (collect_id*977 % 86400) t0 from co), p as (select *, t0 + 2400 t1 from pr),"
    " dy as (select distinct floor(t0/86400) dy from p), f as (select m mission, dy, rk as rank, dy*86400-3600 lo, dy*86400+90000 hi from dy, range(2) a(m), range(2) b(rk) where rk = 0 or dy % 3 <> 0),"
    " ch as (select product, mission, t0, t1, max(case when lo <= t0-1 and hi >= t1+1 then (rank*1000000000 + dy)::bigint end) best from p left join f using (mission) where f.dy between floor(t0/86400)-2 and floor(t0/86400)+2 group by all),"
    " st as (select product, t0, best, lo + k*600 t from ch left join f on ch.best is not null and f.mission = ch.mission and f.rank = best // 1000000000 and f.dy = best % 1000000000, range(157) s(k) where best is not null and lo + k*600 between t0-1 and t1+1),"
    " xy as (select product, t-t0 s, 7e6::double*cos(t % 6000*(2*3.141592653589793::double/6000)) + (best // 1000000000) x from st union all"
    " select product, k*600.0::double, -1.0*k*k from ch, range(4) s(k) where best is null),"
    # Least squares of order two, centred and scaled, by Cramer's rule.
    " mm as (select product, avg(s) c from xy group by 1), uu as (select product, c, (s-c)/1000 u, x from xy join mm using (product)),"
    " ss as (select product, c, count(*) s0, sum(u) s1, sum(u*u) s2, sum(u*u*u) s3, sum(u*u*u*u) s4, sum(x) b0, sum(u*x) b1, sum(u*u*x) b2 from uu group by 1, 2),"
    " dd as (select *, s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2) dt from ss),"
    " cf as (select product, c, (b0*(s2*s4-s3*s3)-s1*(b1*s4-b2*s3)+s2*(b1*s3-b2*s2))/dt a0, (s0*(b1*s4-b2*s3)-b0*(s1*s4-s2*s3)+s2*(s1*b2-s2*b1))/dt a1, (s0*(s2*b2-s3*b1)-s1*(s1*b2-s2*b1)+b0*(s1*s3-s2*s2))/dt a2 from dd)"
    " select product, case when best is null then 'product' else (best // 1000000000)::bigint::varchar || '-' || mission || '-' || (best % 1000000000)::bigint end source,"
    " round(a0 + a1*(1200-c)/1000 + a2*(1200-c)/1000*(1200-c)/1000, 2) + 0.0 x_middle from cf join ch using (product)"
)
def orbit_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collect's position by the best orbit file that holds it, else by its own state vectors; fits of order two."""
    co = views.collects(spark, sf_dir)
    midnight = F.unix_date(F.to_date("collect_start")) * F.lit(86400.0)
    start = midnight + F.hour("collect_start") * 3600 + F.minute("collect_start") * 60 + F.second("collect_start") + F.col("collect_id") * 977 % 86400
    products = co.select(F.col("collect_id").alias("product"), (F.col("collector") % 2).alias("mission"), start.alias("start"), (start + 2400).alias("stop"))
    days = products.select(F.floor(F.col("start") / 86400).alias("d")).distinct()
    kinds = days.withColumn("mission", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).where("rank = 0 or d % 3 <> 0")
    day = F.col("d").cast("double") * 86400
    files = kinds.select(F.concat_ws("-", "rank", "mission", "d").alias("file"), "mission", "rank", F.col("d").alias("created"), (day - 3600).alias("valid_from"), (day + 90000).alias("valid_to"))
    own = products.select("product", F.col("start"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("product", (F.col("start") + F.col("k") * 600).alias("t"), (-1.0 * F.col("k") * F.col("k")).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    states = orbits.overridden(products, own, files, _orbit_states(files))
    fits = orbits.position_fits(states, products, 2)
    at = F.aggregate(F.reverse("x_poly"), F.lit(0.0), lambda a, c: a * 1200 + c)
    sources = states.groupBy("product").agg(F.first("source").alias("source"))
    return fits.join(sources, "product").select("product", "source", rounded(at, 2).alias("x_middle"))
