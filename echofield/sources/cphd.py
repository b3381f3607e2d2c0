"""Phase history files: text header, XML, per-vector parameters and signal arrays.

A vector is a row (channel, vec, its parameters, z). Parameters are doubles and all is
big-endian; samples are pairs of 8- or 16-bit integers or floats. Without the column z
the signal arrays are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .blocks import BLOCK, PIXELS, read_bytes
from .patches import write_patches

SAMPLES = {"CI2": ">i1", "CI4": ">i2", "CF8": ">f4"}

#: Parameters by file name, their number of doubles, and our column names.
PARAMETERS = {
    "TxTime": ["tx_time"], "TxPos": ["tx_x", "tx_y", "tx_z"], "RcvTime": ["rcv_time"], "RcvPos": ["rcv_x", "rcv_y", "rcv_z"],
    "SRPPos": ["srp_x", "srp_y", "srp_z"], "SC0": ["sc0"], "SCSS": ["scss"], "FX1": ["fx1"], "FX2": ["fx2"], "AmpSF": ["amp_sf"],
}
COLUMNS = [c for names in PARAMETERS.values() for c in names]


@dataclass(frozen=True)
class Channel:
    name: str
    vectors: int
    samples: int
    parameters_at: int
    signal_at: int


@dataclass(frozen=True)
class Header:
    element: str
    vector_bytes: int
    offsets: dict[str, int]  # of parameters within a vector, in doubles
    channels: list[Channel]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def read_header(path: str) -> Header:
    head = read_bytes(path, 0, 65536)
    if not head.startswith(b"CPHD/"):
        raise ValueError(f"{path} is not CPHD")
    pairs = dict(re.findall(r"^([A-Z_0-9]+) *:= *(.*?) *$", head.split(b"\f\n")[0].decode(), re.M))
    root = ElementTree.fromstring(read_bytes(path, int(pairs["XML_BLOCK_BYTE_OFFSET"]), int(pairs["XML_BLOCK_SIZE"])))
    for node in root.iter():
        node.tag = _local(node.tag)
    pvp, signal = int(pairs["PVP_BLOCK_BYTE_OFFSET"]), int(pairs["SIGNAL_BLOCK_BYTE_OFFSET"])
    data = root.find("Data")
    if data.find("SignalCompressionID") is not None:
        raise ValueError("compressed signal arrays are not supported")
    channels = [
        Channel(c.findtext("Identifier", ""), int(c.findtext("NumVectors")), int(c.findtext("NumSamples")), pvp + int(c.findtext("PVPArrayByteOffset")), signal + int(c.findtext("SignalArrayByteOffset")))
        for c in data.findall("Channel")
    ]
    offsets = {p.tag: int(p.findtext("Offset")) for p in root.find("PVP")}
    return Header(SAMPLES[data.findtext("SignalArrayFormat")], int(data.findtext("NumBytesPVP")), offsets, channels)


@dataclass
class VectorBlock(InputPartition):
    channel: int
    first: int
    last: int


class CphdReader(DataSourceReader):
    def __init__(self, path: str, with_signal: bool):
        self.path, self.with_signal, self.header = path, with_signal, read_header(path)

    def partitions(self):
        out = []
        for k, channel in enumerate(self.header.channels):
            width = 2 * np.dtype(self.header.element).itemsize * channel.samples if self.with_signal else self.header.vector_bytes
            step = max(1, BLOCK // max(1, width))
            out += [VectorBlock(k, v, min(v + step, channel.vectors) - 1) for v in range(0, channel.vectors, step)]
        return out

    def read(self, partition: VectorBlock) -> Iterator[pa.RecordBatch]:
        step = max(1, PIXELS // max(1, self.header.channels[partition.channel].samples))
        for first in range(partition.first, partition.last + 1, step):
            yield self.batch(VectorBlock(partition.channel, first, min(first + step - 1, partition.last)))

    def batch(self, partition: VectorBlock) -> pa.RecordBatch:
        h, channel = self.header, self.header.channels[partition.channel]
        n = partition.last - partition.first + 1
        raw = read_bytes(self.path, channel.parameters_at + partition.first * h.vector_bytes, n * h.vector_bytes)
        table = np.frombuffer(raw, ">f8").reshape(n, -1).astype(float)
        arrays = [pa.array([channel.name] * n), pa.array(np.arange(partition.first, partition.last + 1))]
        for name, columns in PARAMETERS.items():
            for k in range(len(columns)):
                arrays.append(pa.array(table[:, h.offsets[name] + k]) if name in h.offsets else pa.nulls(n, pa.float64()))
        names = ["channel", "vec", *COLUMNS]
        if self.with_signal:
            width = 2 * np.dtype(h.element).itemsize * channel.samples
            z = np.frombuffer(read_bytes(self.path, channel.signal_at + partition.first * width, n * width), h.element).astype(float).reshape(n, channel.samples, 2)
            if "AmpSF" in h.offsets:
                z = z * table[:, h.offsets["AmpSF"], None, None]
            cells = pa.StructArray.from_arrays([pa.array(z[:, :, 0].ravel()), pa.array(z[:, :, 1].ravel())], names=["re", "im"])
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * channel.samples, pa.int32()), cells))
            names.append("z")
        return pa.RecordBatch.from_arrays(arrays, names=names)


class CphdSource(DataSource):
    """Option signal=false leaves the signal arrays unread."""

    @classmethod
    def name(cls):
        return "cphd"

    def _with_signal(self) -> bool:
        return self.options.get("signal", "true").lower() == "true"

    def schema(self):
        z = ", z array<struct<re:double,im:double>>" if self._with_signal() else ""
        return "channel string, vec long, " + ", ".join(f"{c} double" for c in COLUMNS) + z

    def reader(self, schema):
        return CphdReader(self.options["path"], self._with_signal())


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(CphdSource)


#: Ranges of vec whose sizes the driver adds up.
RANGES = 1024


def _numbered(pulses: DataFrame) -> DataFrame:
    """pulses with their number in order of vec, by counts of ranges of vec."""
    low, high = pulses.agg(F.min("vec"), F.max("vec")).first()
    if low is None:
        return pulses.withColumn("number", F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // RANGES))
    ranged = pulses.withColumn("_range", F.floor((F.col("vec") - low) / width).cast("int"))
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    before, total = [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    starts = pulses.sparkSession.createDataFrame(before, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy("vec"))
    return ranged.join(F.broadcast(starts), "_range").withColumn("number", F.col("_before") + within - 1).drop("_range", "_before")


def write_cphd(pulses: DataFrame, path: str, channel: str = "1", sample_type: str = "CF8") -> None:
    """One channel, in order of vec, written in place by tasks; parameters that pulses lacks are left out."""
    kept = {n: c for n, c in PARAMETERS.items() if all(x in pulses.columns for x in c) and n != "AmpSF"}
    size = pulses.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("z")).alias("m")).first()
    offsets, at = {}, 0
    for name, columns in kept.items():
        offsets[name] = at
        at += len(columns)
    element = SAMPLES[sample_type]
    pvp = "".join(f"<{n}><Offset>{offsets[n]}</Offset><Size>{len(c)}</Size><Format>F8</Format></{n}>" for n, c in kept.items())
    xml = (
        f"<CPHD><Data><SignalArrayFormat>{sample_type}</SignalArrayFormat><NumBytesPVP>{8 * at}</NumBytesPVP><NumCPHDChannels>1</NumCPHDChannels><Channel><Identifier>{channel}</Identifier>"
        f"<NumVectors>{size['n']}</NumVectors><NumSamples>{size['m']}</NumSamples><SignalArrayByteOffset>0</SignalArrayByteOffset><PVPArrayByteOffset>0</PVPArrayByteOffset></Channel></Data><PVP>{pvp}</PVP></CPHD>"
    ).encode()
    start = 1024
    blocks = {"XML_BLOCK": (start, len(xml)), "PVP_BLOCK": (start + len(xml) + 2, 8 * at * size["n"])}
    blocks["SIGNAL_BLOCK"] = (sum(blocks["PVP_BLOCK"]), 2 * np.dtype(element).itemsize * size["m"] * size["n"])
    head = "CPHD/1.0.1\n" + "".join(f"{k}_SIZE := {n}\n{k}_BYTE_OFFSET := {o}\n" for k, (o, n) in blocks.items()) + "\f\n"
    names = [c for columns in kept.values() for c in columns]
    vectors, samples, itemsize = size["n"], size["m"], np.dtype(element).itemsize
    begin = {"p": blocks["PVP_BLOCK"][0], "z": blocks["SIGNAL_BLOCK"][0]}
    step = {"p": 8 * at, "z": 2 * itemsize * samples}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors that follow each other are patches together."""
        for batch in batches:
            number = batch.column("number").to_numpy()
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(">f8") if names else np.zeros((len(number), 0))
            cells, ends = batch.column("z"), batch.column("z").offsets.to_numpy()
            flat = np.stack([cells.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2)], 1).astype(float)
            counts = np.diff(ends)
            z = np.zeros((len(number), samples, 2))
            z[np.repeat(np.arange(len(number)), counts), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], counts)] = flat
            z = (np.round(z) if "i" in element else z).astype(element)
            cuts = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)]
            out = [(begin[k] + int(number[a]) * step[k], part[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False) if a < b for k, part in (("p", table), ("z", z))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["at", "data"])

    patches = _numbered(pulses).select("number", *names, F.transform("z", lambda x: F.struct(x["re"].cast("double").alias("re"), x["im"].cast("double").alias("im"))).alias("z")).mapInArrow(pack, "at long, data binary")
    write_patches(patches, path, begin["z"] + step["z"] * vectors, head.encode().ljust(start, b"\0") + xml + b"\f\n")
