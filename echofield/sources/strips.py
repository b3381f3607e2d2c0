"""Files that are kept in compressed strips.

A folder stands for a file that is large for what it says, such as one of padded texts: each
strip of its bytes is a file of its own, compressed, and is unpacked when bytes of it are read.
Strips that nothing was written to are zeros. Tasks write whole strips; one that runs again
writes the same. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Bytes of a strip before it is compressed, strips that a reader holds, and strips that a task of a large file writes.
STRIP, HELD, PER_TASK = 16 << 20, 2, 8
SUFFIX, ABOUT, CODEC = ".strips", "about.json", "zstd"


def whole(path: str) -> bytes:
    with blocks.opened(path) as f:
        return f.read()


class StripFile:
    """Reads as an opened file does."""

    def __init__(self, path: str):
        self.path, about = path, json.loads(whole(f"{path}/{ABOUT}"))
        self.bytes, self.strip, self.head, self.stored = about["size"], about["strip"], bytes.fromhex(about["head"]), set(about["stored"])
        self.held: OrderedDict[int, bytes] = OrderedDict()

    def __enter__(self) -> StripFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.held.clear()

    def size(self) -> int:
        return self.bytes

    def unpacked(self, k: int) -> bytes:
        if k not in self.held:
            n = min(self.strip, self.bytes - k * self.strip)
            raw = pa.decompress(whole(f"{self.path}/{k}"), n, CODEC, asbytes=True) if k in self.stored else bytes(n)
            head = self.head[k * self.strip : k * self.strip + n]
            self.held[k] = head + raw[len(head) :] if head else raw
            if len(self.held) > HELD:
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def read_at(self, n: int, at: int) -> bytes:
        end, parts = min(at + n, self.bytes), []
        while at < end:
            k, within = divmod(at, self.strip)
            parts.append(self.unpacked(k)[within : within + end - at])
            at += len(parts[-1])
        return parts[0] if len(parts) == 1 else b"".join(parts)


def opened(path: str):
    """A file that is kept in strips, or as it is."""
    return StripFile(path) if path.endswith(SUFFIX) else blocks.opened(path)


def write_strips(rows: DataFrame, data: Column, length: int, path: str, size: int, head: bytes = b"", strip: int = STRIP) -> None:
    """Pieces of ``length`` bytes, ``data``, go to their places ``at``, a column of rows.

    rows are shuffled to the strips that their pieces reach, as they are; pieces are made where
    they are packed. A task holds one strip. ``head`` is a small part that the driver knows.
    """
    if not path.endswith(SUFFIX):
        raise ValueError(f"{path} doesn't end in {SUFFIX}")
    os.makedirs(path)
    n = -(-size // strip)
    tasks = max(1, min(n, max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // PER_TASK))))

    def put(k: int, out: bytearray) -> int:
        part = f"{path}/{k}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(pa.compress(pa.py_buffer(out), CODEC))
        os.replace(part, f"{path}/{k}")
        return k

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, done = None, bytearray(), []
        for batch in batches:
            k, at = (batch.column(i).to_numpy() for i in range(2))
            stored, begin = batch.column(2).buffers()[2], np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :]
            # Pieces that follow each other in a strip are put there at once.
            runs = [0, *(np.flatnonzero((np.diff(at) != length) | (np.diff(k) != 0)) + 1).tolist(), len(k)]
            for first, last in pairwise(runs):
                if k[first] != held:
                    if held is not None:
                        done.append(put(held, out))
                    held = int(k[first])
                    out = bytearray(min(strip, size - held * strip))
                place = int(at[first]) - held * strip
                piece = memoryview(stored)[begin[first] : begin[last]][max(0, -place) : len(out) - place]
                place = max(0, place)
                out[place : place + len(piece)] = piece
        if held is not None:
            done.append(put(held, out))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["strip"])

    reached = F.explode(F.sequence(F.floor(F.col("at") / strip), F.floor((F.col("at") + length - 1) / strip)))
    spread = rows.withColumn("strip", reached).repartitionById(tasks, F.expr(f"cast(strip % {tasks} as int)")).sortWithinPartitions("strip", "at")
    # A number for each strip.
    stored = [r["strip"] for r in spread.select("strip", "at", data.alias("data")).mapInArrow(pack, "strip long").collect()]
    with open(f"{path}/{ABOUT}", "w") as f:
        json.dump({"size": size, "strip": strip, "head": head.hex(), "stored": sorted(stored)}, f)
