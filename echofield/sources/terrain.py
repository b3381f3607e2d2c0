"""Elevation cells and coastlines."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elevations below this are voids or clamped terrain.
LOWEST = -50


def _angle(text: str) -> float:
    """DDDMMSSH."""
    value = int(text[:3]) + int(text[3:5]) / 60 + float(text[5:-1]) / 3600
    return -value if text[-1] in "SW" else value


def decode_dted(content: bytes) -> pd.DataFrame:
    """lat, lon, elev, clamped of a cell: columns of signed-magnitude numbers."""
    if content[:3] != b"UHL":
        raise ValueError("not an elevation cell")
    lon0, lat0 = _angle(content[4:12].decode()), _angle(content[12:20].decode())
    lon_step, lat_step = int(content[20:24]) / 36000, int(content[24:28]) / 36000
    n_lon, n_lat = int(content[47:51]), int(content[51:55])
    at, size = 80 + 648 + 2700, 12 + 2 * n_lat
    records = np.frombuffer(content, np.uint8, n_lon * size, at).reshape(n_lon, size)
    if (records[:, 0] != 0xAA).any():
        raise ValueError("a record doesn't start with its sentinel")
    raw = records[:, 8 : 8 + 2 * n_lat].copy().view(">u2").astype(np.int32)
    elev = np.where(raw & 0x8000, -(raw & 0x7FFF), raw)
    lon, lat = np.meshgrid(lon0 + lon_step * np.arange(n_lon), lat0 + lat_step * np.arange(n_lat), indexing="ij")
    low = elev < LOWEST
    return pd.DataFrame({"lat": lat.ravel(), "lon": lon.ravel(), "elev": np.where(low, LOWEST, elev).ravel().astype(float), "clamped": low.ravel()})


def cell_name(lat: int, lon: int) -> str:
    """Folder and file of a one-degree cell."""
    return f"{'w' if lon < 0 else 'e'}{abs(lon):03d}/{'s' if lat < 0 else 'n'}{abs(lat):02d}"


def cells_within(south: float, west: float, north: float, east: float) -> list[str]:
    return [cell_name(lat, lon) for lat in range(math.floor(south), math.floor(north) + 1) for lon in range(math.floor(west), math.floor(east) + 1)]


def read_dted(spark: SparkSession, paths: list[str] | str, south: float = -90, west: float = -180, north: float = 90, east: float = 180) -> DataFrame:
    """lat, lon, elev, clamped within a rectangle, from elevation cells."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                cell = decode_dted(content)
                yield cell[cell.lat.between(south, north) & cell.lon.between(west, east)]

    files = spark.read.format("binaryFile").load(paths)
    return files.select("content").mapInPandas(decode, "lat double, lon double, elev double, clamped boolean")


def decode_coast(content: bytes) -> Iterator[tuple]:
    """Polygons of a shoreline file: a header of eleven numbers, then points in microdegrees."""
    at, number = 0, 0
    while at < len(content):
        ident, n, flag, west, east, south, north, area, _, _, _ = struct.unpack_from(">11i", content, at)
        points = np.frombuffer(content, ">i4", 2 * n, at + 44).reshape(n, 2) / 1e6
        lon = np.where(points[:, 0] > 180, points[:, 0] - 360, points[:, 0])
        yield number, flag & 255, area / 10, lon, points[:, 1], (west / 1e6, east / 1e6, south / 1e6, north / 1e6)
        number += 1
        at += 44 + 8 * n


def read_coast(spark: SparkSession, path: str, levels: tuple[int, ...] = (1,), least_area: float = 0.0) -> DataFrame:
    """polygon_id, level, area_km2, seq, lat, lon."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for number, level, area, lon, lat, _ in decode_coast(content):
                    if level in levels and area >= least_area:
                        yield pd.DataFrame({"polygon_id": number, "level": level, "area_km2": area, "seq": np.arange(len(lat)), "lat": lat, "lon": lon})

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInPandas(decode, "polygon_id long, level int, area_km2 double, seq long, lat double, lon double")


def read_geoid(spark: SparkSession, path: str, big_endian: bool = False) -> DataFrame:
    """ilat, ilon, und, step: a record-marked grid from the north pole, spacing by its size."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = ">" if big_endian else "<"
        for batch in batches:
            for content in batch["content"]:
                (row_bytes,) = struct.unpack_from(order + "i", content)
                n_lon = row_bytes // 4
                step = 360 / n_lon
                n_lat = round(180 / step) + 1
                rows = np.frombuffer(content, order + "f4").reshape(n_lat, n_lon + 2)[:, 1:-1]
                ilat, ilon = np.meshgrid(round(90 / step) - np.arange(n_lat), np.arange(n_lon), indexing="ij")
                yield pd.DataFrame({"ilat": ilat.ravel(), "ilon": ilon.ravel(), "und": rows.ravel().astype(float), "step": step})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "ilat long, ilon long, und double, step double")


def above_ellipsoid(terrain: DataFrame, geoid: DataFrame, step: float) -> DataFrame:
    """Heights above mean sea level to heights above the ellipsoid."""
    from ..operators.geometry import bilinear

    return bilinear(terrain, geoid, step, "und", wrap=True).withColumn("hae", F.col("elev") + F.col("und"))
