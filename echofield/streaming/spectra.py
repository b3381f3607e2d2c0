"""Spectrograms of streams: overlapping frames of each platform's samples, late ones included.

A platform's state is the samples that no finished frame has taken yet and how many frames
there were. Samples wait until the watermark has passed them, so that late ones can come
in between; then frames of ``size`` samples are cut, one every ``step`` of them, and what no
later frame needs is evicted. A state holds the samples of the lateness that is allowed and
less than a frame. A stream that is stopped goes on from its checkpoint, and the frames are
those of the whole series in order, as ``frames`` cuts them from a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.spectral import kaiser

SCHEMA = "platform long, frame long, start long, bin int, power double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _powers(z: np.ndarray, beta: float) -> np.ndarray:
    """Centred power of each bin of windowed frames, a row for each."""
    n = z.shape[1]
    return np.abs(np.fft.fftshift(np.fft.fft(z * kaiser(n, beta), axis=1), axes=1)) ** 2


def _rows(platform: int, first: int, starts: np.ndarray, power: np.ndarray) -> pd.DataFrame:
    m, n = power.shape
    return pd.DataFrame(
        {
            "platform": np.full(m * n, platform, np.int64),
            "frame": np.repeat(np.arange(first, first + m, dtype=np.int64), n),
            "start": np.repeat(starts.astype(np.int64), n),
            "bin": np.tile(np.arange(n, dtype=np.int32), m),
            "power": power.ravel(),
        }
    )


class Frames(StatefulProcessor):
    """Samples have platform, us (microseconds), re and im."""

    def __init__(self, size: int, step: int, beta: float):
        self.size, self.step, self.beta = size, step, beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, re double, im double")
        self.done = handle.getValueState("done", "frames long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(int(t), float(a), float(b)) for t, a, b in zip(part["us"], part["re"], part["im"], strict=True)])
            # Frames can be cut from when the watermark passes the first of these samples.
            self.handle.registerTimer(int(part["us"].min()) // 1000 + 1)
        yield pd.DataFrame(columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"platform": "int64", "frame": "int64", "start": "int64", "bin": "int32", "power": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get())
        ready = sum(us < mark for us, _, _ in held)
        count = max(0, (ready - self.size) // self.step + 1)
        if count:
            samples = np.array([(us, re, im) for us, re, im in held[: (count - 1) * self.step + self.size]])
            first = self.done.get()[0] if self.done.exists() else 0
            at = np.arange(count)[:, None] * self.step + np.arange(self.size)
            power = _powers((samples[:, 1] + 1j * samples[:, 2])[at], self.beta)
            starts = samples[:: self.step][:count, 0]
            self.done.update((first + count,))
            held = held[count * self.step :]
            self.waiting.clear()
            if held:
                self.waiting.put(held)
        if held and held[-1][0] >= mark:
            # The next frame ends with this sample, or with one that isn't there yet.
            end = held[min(self.size, len(held)) - 1][0]
            self.handle.registerTimer(max(end, mark) // 1000 + 1)
        if count:
            yield _rows(int(key[0]), first, starts, power)

    def close(self) -> None:
        pass


def streamed(samples: DataFrame, size: int, step: int, late: str, beta: float = 5.0) -> DataFrame:
    """Frames of a stream of (platform, ts, re, im), as their samples are passed by the watermark.

    Samples that come later than ``late`` behind the newest are left out. Needs a state store
    with lists and timers; ``prepared`` sets one.
    """
    marked = samples.select(F.col("platform").cast("long"), "ts", F.unix_micros("ts").alias("us"), "re", "im").withWatermark("ts", late)
    return marked.groupBy("platform").transformWithStateInPandas(Frames(size, step, beta), SCHEMA, "Append", "EventTime")


def prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def frames(samples: DataFrame, size: int, step: int, beta: float = 5.0) -> DataFrame:
    """The same frames of a table of (platform, us, re, im).

    A sample belongs to size / step frames at most and is sent to each; a frame is a group.
    """
    order = Window.partitionBy("platform").orderBy("us", "re", "im")
    each = samples.withColumn("k", F.row_number().over(order) - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("k") - size + 1) / step))
    spread = each.withColumn("frame", F.explode(F.sequence(low.cast("long"), F.floor(F.col("k") / step))))
    cell = F.struct("k", "us", "re", "im")
    whole = spread.groupBy("platform", "frame").agg(F.sort_array(F.collect_list(cell)).alias("z")).where(F.size("z") == size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for platform, frame, z in zip(b["platform"], b["frame"], b["z"], strict=True):
                values = np.array([[x["re"] + 1j * x["im"] for x in z]])
                yield _rows(int(platform), int(frame), np.array([z[0]["us"]], np.int64), _powers(values, beta))

    return whole.mapInPandas(run, SCHEMA)


def frames_within(samples: int, size: int, step: int) -> int:
    return max(0, math.floor((samples - size) / step) + 1)
