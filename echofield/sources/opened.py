"""Open a raster or phase history by what its first bytes say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cphd, hdf5, nitf, probe, sicd
from .blocks import FlatSource
from .cosar import CosarSource
from .sio import SioSource
from .tiff import TiffSource
from .tiles import BlockedSource

#: The data source for each format that has one.
READERS = {"sicd": "sicd", "nitf": "nitf", "cosar": "cosar", "sio": "sio", "tiff": "tiffraster", "cphd": "cphd", "iceye": "hdf5raster", "nisar": "hdf5raster", "csm": "hdf5raster"}


def format_of(path: str) -> str | None:
    """The name of the data source that reads a file, by what its headers say; null if none does."""
    return READERS.get(probe.format_of(path))


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FlatSource, BlockedSource, SioSource, CosarSource, TiffSource):
        spark.dataSource.register(source)
    for module in (sicd, nitf, hdf5, cphd):
        module.registered(spark)


def open_reader(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The pixels (or pulses) of a file of any known format."""
    name = format_of(path)
    if name is None:
        raise ValueError(f"the format of {path} is not known")
    registered(spark)
    return spark.read.format(name).options(**options).load(path)
