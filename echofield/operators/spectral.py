"""Discrete Fourier transforms of image lines, and what is built from them.

Lines are packed: a row (r, z) holds a line as an array of (re, im). Two forms give the
same numbers. ``relational`` multiplies the long form with a table of n twiddle rows
and sums, all in the JVM; its cost is n per sample, right for short lines and for SQL.
``transformed`` runs numpy's FFT over Arrow batches of packed lines, n log n, without a
shuffle. Along columns, lines are first turned by a grouping.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = "r long, z array<struct<re:double,im:double>>"


def packed(px: DataFrame, by: str = "r", along: str = "c") -> DataFrame:
    """Long form to lines; samples missing from a line are left out."""
    cell = F.struct(F.col(along).alias("at"), F.col("re"), F.col("im"))
    rows = px.groupBy(F.col(by).alias("r")).agg(F.sort_array(F.collect_list(cell)).alias("z"))
    return rows.select("r", F.transform("z", lambda x: F.struct(x["re"].alias("re"), x["im"].alias("im"))).alias("z"))


def unpacked(lines: DataFrame, by: str = "r", along: str = "c") -> DataFrame:
    each = lines.select(F.col("r").alias("line"), F.posexplode("z").alias("place", "v"))
    return each.select(F.col("line").alias(by), F.col("place").cast("long").alias(along), F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def turned(lines: DataFrame) -> DataFrame:
    """Rows become columns: one shuffle."""
    return packed(unpacked(lines), by="c", along="r")


def on_lines(lines: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel to each line; lines of a batch that are equally long go together."""
    return on_numbered_lines(lines, lambda _, z: kernel(z))


def on_numbered_lines(lines: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``on_lines`` for kernels that depend on the numbers of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, column = batch.column(0).to_numpy(), batch.column(1)
            offsets = column.offsets.to_numpy()
            values = column.values
            z = values.field(0).to_numpy(zero_copy_only=False) + 1j * values.field(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            out: list[np.ndarray] = [np.zeros(0)] * len(sizes)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                for k, line in zip(at, kernel(numbers[at], z[offsets[at][:, None] + np.arange(n)]), strict=True):
                    out[k] = line
            flat = np.concatenate(out) if out else np.zeros(0, complex)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], names=["re", "im"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), cells)], names=["r", "z"])

    return lines.select(F.col("r").cast("long"), "z").mapInArrow(run, LINE)


def transformed(lines: DataFrame, inverse: bool = False, shift: bool = False) -> DataFrame:
    def kernel(z: np.ndarray) -> np.ndarray:
        out = np.fft.ifft(z, axis=1) if inverse else np.fft.fft(z, axis=1)
        return np.fft.fftshift(out, axes=1) if shift else out

    return on_lines(lines, kernel)


def transformed_2d(lines: DataFrame, sign: int = -1, shift: bool = True) -> DataFrame:
    """Both axes; the sign of the image's transform decides the direction."""
    inverse = sign > 0
    return turned(transformed(turned(transformed(lines, inverse, shift)), inverse, shift))


def relational(px: DataFrame, n: int, inverse: bool = False, size: int | None = None) -> DataFrame:
    """(r, k, re, im): the transform of lines of n samples, padded with zeros to size.

    The twiddles are computed in the projection, so that no table of them is joined.
    """
    size = size or n
    sign = 1.0 if inverse else -1.0
    bins = F.sequence(F.lit(0), F.lit(size - 1))
    each = px.select("r", "c", "re", "im", F.explode(bins).alias("k"))
    angle = F.lit(sign * 2 * math.pi / size) * ((F.col("k") * F.col("c")) % size)
    re = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)
    im = F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    scale = 1.0 / size if inverse else 1.0
    return each.groupBy("r", F.col("k").cast("long").alias("k")).agg((F.sum(re) * scale).alias("re"), (F.sum(im) * scale).alias("im"))


def padded(lines: DataFrame, size: int) -> DataFrame:
    """Transform of lines with zeros behind them."""
    return on_lines(lines, lambda z: np.fft.fft(z, size, axis=1))


def padded_inverse(lines: DataFrame, rate: float) -> DataFrame:
    """Centred inverse transform, padded with zeros to floor(n * rate)."""

    def kernel(z: np.ndarray) -> np.ndarray:
        n = z.shape[1]
        size = int(math.floor(n * rate))
        padded = np.zeros((len(z), size), complex)
        start = (size - n) // 2
        padded[:, start : start + n] = z
        return np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(padded, axes=1), axis=1), axes=1)

    return on_lines(lines, kernel)


def upsampled(lines: DataFrame, size: int) -> DataFrame:
    """Lines resampled to size by padding or cropping their spectra."""

    def kernel(z: np.ndarray) -> np.ndarray:
        n = z.shape[1]
        spectrum = np.fft.fftshift(np.fft.fft(z, axis=1), axes=1)
        out = np.zeros((len(z), size), complex)
        m = min(n, size)
        out[:, size // 2 - m // 2 : size // 2 - m // 2 + m] = spectrum[:, n // 2 - m // 2 : n // 2 - m // 2 + m]
        return np.fft.ifft(np.fft.ifftshift(out, axes=1), axis=1) * size / n

    return on_lines(lines, kernel)


# Weighting


def raised_cosine(n: int, coefficient: float) -> np.ndarray:
    return coefficient - (1 - coefficient) * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))


def bessel_i0(x: np.ndarray) -> np.ndarray:
    return np.i0(x)


def kaiser(n: int, beta: float) -> np.ndarray:
    place = 2 * np.arange(n) / max(n - 1, 1) - 1
    return bessel_i0(beta * np.sqrt(np.maximum(0, 1 - place**2))) / bessel_i0(np.array(beta))


def taylor(n: int, sidelobe_db: float = -30.0, nbar: int = 4) -> np.ndarray:
    a = np.arccosh(10 ** (-sidelobe_db / 20)) / np.pi
    sigma2 = nbar**2 / (a**2 + (nbar - 0.5) ** 2)
    m = np.arange(1, nbar)
    terms = []
    for k in m:
        top = (-1) ** (k + 1) * np.prod(1 - k**2 / sigma2 / (a**2 + (m - 0.5) ** 2))
        terms.append(top / (2 * np.prod([1 - k**2 / j**2 for j in m if j != k])))
    place = (np.arange(n) - (n - 1) / 2) / n
    return 1 + 2 * sum(f * np.cos(2 * np.pi * k * place) for f, k in zip(terms, m, strict=True))


def weights(name: str, n: int, **parameters: float) -> np.ndarray:
    """The window that a weighting type names."""
    kinds = {
        "UNIFORM": lambda: np.ones(n),
        "RAISED_COSINE": lambda: raised_cosine(n, parameters.get("coefficient", 0.5)),
        "HAMMING": lambda: raised_cosine(n, parameters.get("coefficient", 0.54)),
        "HANNING": lambda: raised_cosine(n, 0.5),
        "KAISER": lambda: kaiser(n, parameters.get("beta", 2.5)),
        "TAYLOR": lambda: taylor(n, parameters.get("sidelobe_db", -30.0), int(parameters.get("nbar", 4))),
    }
    if name.upper() not in kinds:
        raise ValueError(f"unknown weighting {name}")
    return kinds[name.upper()]()


def broadening(window: np.ndarray) -> float:
    """Half-power width of the window's response, in units of 1 / bandwidth."""
    over = 1024
    response = np.abs(np.fft.fft(window, len(window) * over))
    response /= response[0]
    half = 1 / math.sqrt(2)
    at = int(np.flatnonzero(response < half)[0])
    exact = at - 1 + (response[at - 1] - half) / (response[at - 1] - response[at])
    return 2 * exact / over


def broadenings(sizes: DataFrame, names: list[str]) -> DataFrame:
    """(window, n, width) for each size n and each name of a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, n, broadening(weights(name, n))) for n in b["n"].tolist() for name in names]
            yield pd.DataFrame(rows, columns=["window", "n", "width"])

    return sizes.select(F.col("n").cast("long")).mapInPandas(run, "window string, n long, width double")


def deweighted(lines: DataFrame, window: str, oversample: float = 1.0, **parameters: float) -> DataFrame:
    """Divide the spectrum by the window on its support; uniform windows pass."""
    if window.upper() == "UNIFORM":
        return lines

    def kernel(z: np.ndarray) -> np.ndarray:
        n = z.shape[1]
        support = int(round(n / oversample))
        first = (n - support) // 2
        spectrum = np.fft.fftshift(np.fft.fft(z, axis=1), axes=1)
        spectrum[:, first : first + support] /= weights(window, support, **parameters)
        return np.fft.ifft(np.fft.ifftshift(spectrum, axes=1), axis=1)

    return on_lines(lines, kernel)


def deskewed(px: DataFrame, coefficients: list[float], sign: int, spacing: float, centre: int) -> DataFrame:
    """Multiply by exp(j sign 2 pi integral of the centre frequency polynomial).

    coefficients: the spectrum's centre along c, ascending, in metres from the centre.
    A zero polynomial passes.
    """
    from ..functions.cx import cx, unit
    from ..functions.poly import polyval

    if not any(coefficients):
        return px
    whole = F.array(F.lit(0.0), *[F.lit(x / (k + 1)) for k, x in enumerate(coefficients)])
    phase = polyval(whole, (F.col("c") - centre) * spacing) * (sign * 2 * math.pi)
    out = cx() * unit(phase)
    return px.withColumn("_re", out.re).withColumn("im", out.im).withColumn("re", F.col("_re")).drop("_re")


def normalised(px: DataFrame, coefficients: list[float], sign: int, spacing: float, centre: int, window: str = "UNIFORM", **parameters: float) -> DataFrame:
    """Deskewed, conjugated for a positive sign, and deweighted along c."""
    out = deskewed(px, coefficients, sign, spacing, centre)
    if sign > 0:
        out = out.withColumn("im", -F.col("im"))
    return out if window.upper() == "UNIFORM" else unpacked(deweighted(packed(out), window, **parameters))


# Products of the spectrum


def subapertures(lines: DataFrame, frames: int = 7, fraction: float = 0.25, fill: float = 1.0) -> DataFrame:
    """(frame, r, z): overlapping slices of the spectrum, each transformed back at full size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                z = np.array([complex(x["re"], x["im"]) for x in row["z"]])
                n = len(z)
                support = int(round(n / fill))
                first = (n - support) // 2
                spectrum = np.fft.fftshift(np.fft.fft(z))[first : first + support]
                width = int(math.ceil(support * fraction))
                starts = np.round(np.linspace(0, support - width, frames)).astype(int) if frames > 1 else np.array([(support - width) // 2])
                for k, start in enumerate(starts.tolist()):
                    part = np.zeros(n, complex)
                    part[n // 2 - width // 2 : n // 2 - width // 2 + width] = spectrum[start : start + width]
                    back = np.fft.ifft(np.fft.ifftshift(part))
                    out.append({"frame": k, "r": row["r"], "z": [{"re": float(x.real), "im": float(x.imag)} for x in back]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("frame", pa.int64()), ("r", pa.int64()), ("z", pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])))]))

    return lines.select(F.col("r").cast("long"), "z").mapInArrow(run, "frame long, r long, z array<struct<re:double,im:double>>")


def colour_filters(n: int) -> np.ndarray:
    """Three overlapping triangles over a spectrum of n bins."""
    place = (np.arange(n) + 0.5) / n
    return np.stack([np.clip(1 - np.abs(place - centre) * 2, 0, 1) for centre in (0.0, 0.5, 1.0)]) * np.array([[1.0], [1.0], [1.0]])


def colour_subapertures(lines: DataFrame) -> DataFrame:
    """(band, r, z): the line filtered to the low, middle and high part of its spectrum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                z = np.array([complex(x["re"], x["im"]) for x in row["z"]])
                spectrum = np.fft.fftshift(np.fft.fft(z))
                for k, colour in enumerate(colour_filters(len(z))):
                    back = np.fft.ifft(np.fft.ifftshift(spectrum * colour))
                    out.append({"band": k, "r": row["r"], "z": [{"re": float(x.real), "im": float(x.imag)} for x in back]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("band", pa.int64()), ("r", pa.int64()), ("z", pa.list_(pa.struct([("re", pa.float64()), ("im", pa.float64())])))]))

    return lines.select(F.col("r").cast("long"), "z").mapInArrow(run, "band long, r long, z array<struct<re:double,im:double>>")


def mean_power_spectrum(px: DataFrame, n: int) -> DataFrame:
    """(k, db): mean power of each bin over the lines, in decibels above the least.

    Lines are gathered once and transformed in batches; missing samples are zeros. A task
    sends one sum for each bin.
    """
    lines = px.groupBy("r").agg(F.collect_list(F.struct(F.col("c").cast("long").alias("c"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(n), 0
        for batch in batches:
            column = batch.column(0)
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            cells = column.flatten()
            place, re, im = (cells.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            z = np.zeros((len(column), n), complex)
            z[row, place] = re + 1j * im
            total += (np.abs(np.fft.fft(z, axis=1)) ** 2).sum(axis=0)
            held += len(column)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(np.full(n, held))], names=["k", "power", "lines"])

    sums = lines.select("z").mapInArrow(run, "k long, power double, lines long").groupBy("k").agg((F.sum("power") / F.sum("lines")).alias("power"))
    level = sums.select("k", (10 * F.log10("power")).alias("db"))
    least = level.agg(F.min("db").alias("least"))  # one row
    return level.join(F.broadcast(least)).select("k", (F.col("db") - F.col("least")).alias("db"))


def spectrogram(lines: DataFrame, overlap: float = 0.9, beta: float = 5.0) -> DataFrame:
    """(r, frame, bin, db) of each line with a Kaiser window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                z = np.array([complex(x["re"], x["im"]) for x in row["z"]])
                size = min(len(z), 4 * 2 ** math.ceil(math.log2(max(1.0, math.sqrt(len(z))))))
                window = kaiser(max(1, int(0.97 * size)), beta)
                step = max(1, int(round(len(window) * (1 - overlap))))
                for frame, start in enumerate(range(0, len(z) - len(window) + 1, step)):
                    power = np.abs(np.fft.fftshift(np.fft.fft(z[start : start + len(window)] * window, size))) ** 2
                    for column, values in zip(out, ([row["r"]] * size, [frame] * size, range(size), 10 * np.log10(power + 1e-30)), strict=True):
                        column.extend(values)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["r", "frame", "bin", "db"])

    return lines.select(F.col("r").cast("long"), "z").mapInArrow(run, "r long, frame long, bin long, db double")
