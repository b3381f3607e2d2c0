"""A stream's frames are those of the whole series, late samples and restarts included."""

from __future__ import annotations

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofield.streaming import spectra

SIZE, STEP = 8, 3


def samples(spark, n: int = 60):
    """Three platforms whose samples come out of order by up to three seconds."""
    rng = np.random.default_rng(4)
    rows = [(p, float(k), float(rng.normal()), float(rng.normal()), k + rng.uniform(0, 3)) for p in range(3) for k in range(n - 7 * p)]
    rows.sort(key=lambda x: x[-1])
    return spark.createDataFrame([x[:4] for x in rows], "platform long, s double, re double, im double").select("platform", F.timestamp_micros((F.col("s") * 1e6 + 1e12).cast("long")).alias("ts"), "re", "im"), rows


def values(df) -> dict:
    return {(r.platform, r.frame, r.bin): (r.start, r.power) for r in df.collect()}


@pytest.fixture
def parts(spark, tmp_path):
    """The samples as files that come one after another."""
    df, rows = samples(spark)
    files = []
    for k in range(0, len(rows), 20):
        path = str(tmp_path / f"part-{k}")
        spark.createDataFrame([x[:4] for x in rows[k : k + 20]], "platform long, s double, re double, im double").select(
            "platform", F.timestamp_micros((F.col("s") * 1e6 + 1e12).cast("long")).alias("ts"), "re", "im"
        ).coalesce(1).write.parquet(path)
        files.append(path)
    return df, files


def test_frames_of_a_table(spark):
    df, rows = samples(spark)
    found = values(spectra.frames(df.select("platform", F.unix_micros("ts").alias("us"), "re", "im"), SIZE, STEP))
    want = {}
    for p in range(3):
        own = sorted(x[1:4] for x in rows if x[0] == p)
        z = np.array([a + 1j * b for _, a, b in own])
        for f in range(spectra.frames_within(len(own), SIZE, STEP)):
            power = np.abs(np.fft.fftshift(np.fft.fft(z[f * STEP : f * STEP + SIZE] * np.kaiser(SIZE, 5.0)))) ** 2
            want |= {(p, f, k): power[k] for k in range(SIZE)}
    assert found.keys() == want.keys() and all(found[k][1] == pytest.approx(v) for k, v in want.items())


def test_a_stream_and_its_restart(spark, tmp_path, parts):
    df, files = parts
    spectra.prepared(spark)
    inbox, out, checkpoint = (str(tmp_path / x) for x in ("inbox", "out", "checkpoint"))

    def run(some: list[str]) -> None:
        for path in some:
            name = path.rsplit("/")[-1]
            for k, f in enumerate(sorted(tmp_path.joinpath(name).glob("*.parquet"))):
                (tmp_path / "inbox").mkdir(exist_ok=True)
                shutil.copy(f, f"{inbox}/{name}-{k}.parquet")
                # Files of a stream come in order of their times.
                at = 1_700_000_000 + int(name.split("-")[1])
                os.utime(f"{inbox}/{name}-{k}.parquet", (at, at))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        made = spectra.streamed(stream, SIZE, STEP, "4 seconds")
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(200)

    run(files[:4])
    first = values(spark.read.parquet(out))
    run(files[4:])  # another query, from the checkpoint
    found = values(spark.read.parquet(out))
    whole = values(spectra.frames(df.select("platform", F.unix_micros("ts").alias("us"), "re", "im"), SIZE, STEP))
    # The last samples wait for the watermark to pass them.
    newest = df.agg(F.max(F.unix_micros("ts"))).first()[0] - 4_000_000
    ends = {(p, f): start + (SIZE - 1) * 1_000_000 for (p, f, _), (start, _) in whole.items()}
    done = {k: v for k, v in whole.items() if ends[k[:2]] < newest}
    assert 0 < len(first) < len(found) and found.keys() == done.keys()
    assert all(found[k][0] == v[0] and found[k][1] == pytest.approx(v[1]) for k, v in done.items())
