"""Least squares for many groups at once.

Sums of powers are one aggregation with partial sums; each group's small system is solved
where its row is, a batch of rows at a time. Nothing reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _power(x: Column, k: int) -> Column:
    return F.pow(x, F.lit(float(k))) if k else F.lit(1.0)


def polynomials(samples: DataFrame, keys: list[str], x: str, values: list[str], order: int) -> DataFrame:
    """keys, and for each value the coefficients of ascending powers of x: an array ``<value>_poly``.

    A group with fewer different x than the order asks for gets the least coefficients
    that fit. x is centred and scaled by group for the sums.
    """
    spans = samples.groupBy(*keys).agg(F.avg(x).alias("_centre"), F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias("_scale"))
    u = (F.col(x) - F.col("_centre")) / F.col("_scale")
    sums = [F.sum(_power(u, k)).alias(f"_s{k}") for k in range(2 * order + 1)]
    sums += [F.sum(_power(u, k) * F.col(v)).alias(f"_b{k}_{v}") for v in values for k in range(order + 1)]
    each = samples.join(spans, keys).groupBy(*keys, "_centre", "_scale").agg(*sums)
    names = [f"{v}_poly" for v in values]
    schema = ", ".join([f"`{k}` {dict(samples.dtypes)[k]}" for k in keys] + [f"`{n}` array<double>" for n in names])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            matrix = np.stack([[b[f"_s{i + j}"].to_numpy() for j in range(order + 1)] for i in range(order + 1)]).transpose(2, 0, 1)
            right = np.stack([[b[f"_b{k}_{v}"].to_numpy() for v in values] for k in range(order + 1)]).transpose(2, 0, 1)
            found = np.linalg.pinv(matrix, rcond=1e-13, hermitian=True) @ right
            moved = _moved(found, b["_centre"].to_numpy(), b["_scale"].to_numpy())
            yield b[keys].assign(**{n: list(moved[:, :, k]) for k, n in enumerate(names)})

    return each.mapInPandas(solve, schema)


def _moved(found: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Coefficients over u = (x - centre) / scale as coefficients over x."""
    out = np.zeros_like(found)
    n = found.shape[1]
    for k in reversed(range(n)):  # Horner: out * u + c
        grown = np.zeros_like(out)
        grown[:, 1:] = out[:, :-1]
        out = (grown - out * centre[:, None, None]) / scale[:, None, None]
        out[:, 0] += found[:, k]
    return out


def surfaces(rows: DataFrame, x: str, y: str, values: list[str], order: tuple[int, int]) -> DataFrame:
    """Adds ``<value>_poly`` to each row: coefficients [m][n] of x**m * y**n, by least squares.

    x, y and the values are arrays of a row's samples, all of one length.
    """
    names = [f"{v}_poly" for v in values]
    powers = [(m, n) for m in range(order[0] + 1) for n in range(order[1] + 1)]
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"`{n}` array<array<double>>" for n in names])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            xs, ys = (np.stack(b[c].to_numpy()) for c in (x, y))
            sx, sy = (np.maximum(np.abs(a).max(axis=1), 1e-300) for a in (xs, ys))
            u, v = xs / sx[:, None], ys / sy[:, None]
            matrix = np.stack([u**m * v**n for m, n in powers], axis=2)
            found = np.linalg.pinv(matrix) @ np.stack([np.stack(b[c].to_numpy()) for c in values], axis=2)
            unit = np.stack([sx**m * sy**n for m, n in powers], axis=1)
            found = (found / unit[:, :, None]).reshape(len(b), order[0] + 1, order[1] + 1, len(values))
            yield b.assign(**{n: [list(map(list, c)) for c in found[:, :, :, k]] for k, n in enumerate(names)})

    return rows.mapInPandas(solve, schema)
