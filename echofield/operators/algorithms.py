"""Metadata that depends on how an image was formed, and the grids that formation needs.

Every function is Column arithmetic on a catalog row; fields that are there stay.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import LIGHT, normal
from ..functions.vectors import Vec, vec
from .geometry import _kept, _vec

UNIFORM_BROADENING = 0.886


def _chosen(cases: dict[str, Vec]) -> Vec:
    """The vector of the row's algorithm."""

    def pick(axis: str) -> Column:
        out = F.lit(None).cast("double")
        for name, v in cases.items():
            out = F.when(F.col("algorithm") == name, getattr(v, axis)).otherwise(out)
        return out

    return Vec(pick("x"), pick("y"), pick("z"))


def algorithm_fields(df: DataFrame) -> DataFrame:
    """Adds row_*, col_*, k_row, k_col, azimuth_scale and closest_range by image formation algorithm.

    df: algorithm (RGAZCOMP, PFA, RMAT, RMCR or INCA), scp_*, arp_*, vel_*, the closest
    approach's position ca_* and velocity cv_*, centre frequency fc; k_row and k_col stay
    where they are given.
    """
    scp, arp, vel = vec("scp"), vec("arp"), vec("vel")
    los, slant, along, image, focus = (_vec(x) for x in ("_los", "_sn", "_yat", "_ipn", "_fpn"))
    near, flight, toward, plane = vec("ca"), vec("cv"), _vec("_rg"), _vec("_cn")
    own = _kept(df, "_los", (scp - arp).unit())
    own = own.withColumn("_look", F.signum(arp.cross(vel).dot(los)))
    look = F.col("_look")
    own = _kept(own, "_sn", (vel.cross(los) * look).unit())
    own = _kept(own, "_yat", vel.unit() * (look * -1.0))
    own = _kept(own, "_xn", los.cross(along).unit())
    # Slant plane and ground plane are the default planes of the image and of focus.
    own = _kept(_kept(own, "_ipn", slant), "_fpn", normal(scp))
    moved = arp + focus * ((scp - arp).dot(image) / focus.dot(image))
    own = _kept(own, "_pr", (scp - moved).unit())
    own = _kept(own, "_rg", (scp - near).unit())
    own = own.withColumn("_ca_look", F.signum(near.cross(flight).dot(toward)))
    own = _kept(own, "_cn", (toward.cross(flight) * (F.col("_ca_look") * -1.0)).unit())
    cross_track = along.cross(_vec("_xn"))
    own = _kept(own, "row", _chosen({"RGAZCOMP": los, "PFA": _vec("_pr"), "RMAT": cross_track, "RMCR": los, "INCA": toward}))
    own = _kept(own, "col", _chosen({"RGAZCOMP": slant.cross(los), "PFA": image.cross(_vec("_pr")), "RMAT": along, "RMCR": slant.cross(los), "INCA": plane.cross(toward)}))
    cone = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vel.unit().dot(los))))
    centre = F.col("fc") * (2 / LIGHT)
    algorithm = F.col("algorithm")
    k_row = F.when(algorithm == "RMAT", centre * F.sin(cone)).otherwise(centre)
    k_col = F.when(algorithm == "RMAT", centre * F.cos(cone)).otherwise(0.0)
    own = own.withColumns(
        {
            "k_row": F.coalesce(F.col("k_row"), k_row) if "k_row" in df.columns else k_row,
            "k_col": F.coalesce(F.col("k_col"), k_col) if "k_col" in df.columns else k_col,
            "azimuth_scale": F.when(algorithm == "RGAZCOMP", -look * F.sin(cone) / (scp - arp).norm()),
            "closest_range": F.when(algorithm == "INCA", (near - scp).norm()),
        }
    )
    return own.drop("_look", "_ca_look", *[f"{n}_{a}" for n in ("_los", "_sn", "_yat", "_xn", "_ipn", "_fpn", "_pr", "_rg", "_cn") for a in "xyz"])


def wavenumber_bounds(corners: list[Column], bandwidth: Column, spacing: Column) -> tuple[Column, Column]:
    """Least and greatest wavenumber offset of an axis.

    corners: the centre's polynomial at the image's corners. A spectrum that wraps has
    the whole band.
    """
    low, high = F.least(*corners) - bandwidth / 2, F.greatest(*corners) + bandwidth / 2
    edge = 1 / (2 * spacing)
    wraps = (low < -edge) | (high > edge)
    return F.when(wraps, -edge).otherwise(low), F.when(wraps, edge).otherwise(high)


def polar_axis(first: Column, last: Column, rate: Column | float, centred: bool = False) -> dict[str, Column]:
    """An axis of a polar-format image from its bounds in wavenumbers."""
    band = last - first
    return {"bandwidth": band, "width": UNIFORM_BROADENING / band, "spacing": 1 / (rate * band), "centre": F.lit(0.0) if centred else (first + last) / 2}


def compressed_axes(sc0: Column, scss: Column, samples: Column, pulses: Column, n_rows: Column, n_cols: Column, speed: Column, cone: Column, distance: Column, pulse_rate: Column) -> dict[str, Column]:
    """Both axes of a range-azimuth compressed image, by steps of wavenumber."""
    centre = (2 / LIGHT) * (sc0 + scss * (samples - 1) / 2)
    row_step = (2 / LIGHT) * scss
    col_step = centre * (speed * F.sin(cone) / distance) / pulse_rate
    row_band, col_band = (samples - 1) * row_step, (pulses - 1) * col_step
    return {
        "row_centre": centre,
        "row_bandwidth": row_band,
        "row_width": UNIFORM_BROADENING / row_band,
        "row_spacing": 1 / ((n_rows - 1) * row_step),
        "col_bandwidth": col_band,
        "col_width": UNIFORM_BROADENING / col_band,
        "col_spacing": 1 / ((n_cols - 1) * col_step),
    }


def formation_grid(df: DataFrame, kind: str, rate: float = 1.5) -> DataFrame:
    """Adds row_*, col_* unit vectors, n_rows, n_cols, spacings and widths of a grid for backprojection.

    df: centre_*, mid_* (the middle pulse's position), first_* and last_* positions,
    range_extent, cross_extent, range_resolution, cross_resolution. kind: slant or
    ground; extents and resolutions of a ground grid are the slant plane's, spread.
    """
    if kind not in ("slant", "ground"):
        raise ValueError(f"unknown grid {kind}")
    centre = vec("centre")
    sight, flight, up = _vec("_st"), _vec("_fl"), _vec("_up")
    own = _kept(_kept(_kept(df, "_st", (centre - vec("mid")).unit()), "_fl", vec("last") - vec("first")), "_up", normal(centre))
    own = own.withColumn("_side", F.signum(centre.dot(sight.cross(flight))))
    own = _kept(own, "_sn", sight.cross(flight).unit() * F.col("_side"))
    slant = _vec("_sn")
    if kind == "slant":
        spread, stretch = F.lit(1.0), F.lit(1.0)
        own = _kept(own, "row", sight)
        own = _kept(own, "col", _vec("row").cross(slant) * -1.0)
    else:
        away = sight * -1.0
        spread = F.cos(F.asin(up.dot(away)))
        stretch = F.cos(F.asin(up.cross(slant).dot(away) / away.cross(up).norm()))
        own = _kept(own, "row", sight.across(up).unit())
        own = _kept(own, "col", (_vec("row").cross(up) * -1.0).unit())
    own = own.withColumns({"_re": F.col("range_extent") / spread, "_ce": F.col("cross_extent") / stretch, "_rr": F.col("range_resolution") / spread, "_cr": F.col("cross_resolution") / stretch})
    own = own.withColumns({"n_rows": F.ceil(F.col("_re") * rate / F.col("_rr")), "n_cols": F.ceil(F.col("_ce") * rate / F.col("_cr"))})
    own = own.withColumns(
        {"row_spacing": F.col("_re") / F.col("n_rows"), "col_spacing": F.col("_ce") / F.col("n_cols"), "row_width": UNIFORM_BROADENING * F.col("range_resolution"), "col_width": UNIFORM_BROADENING * F.col("cross_resolution")}
    )
    return own.drop("_side", "_re", "_ce", "_rr", "_cr", *[f"{n}_{a}" for n in ("_st", "_fl", "_up", "_sn") for a in "xyz"])


def is_normalized(centre_polynomial: Column, window: Column, weights: Column, sign: Column) -> Column:
    """No skew to take out, uniform weights, and a transform of negative sign; missing fields pass."""
    skewed = F.coalesce(F.exists(centre_polynomial, lambda x: x != 0), F.lit(False))
    steps = F.transform(F.sequence(F.lit(0), F.size(weights) - 2), lambda k: F.get(weights, k + 1) != F.get(weights, k))
    uneven = F.coalesce(window != "UNIFORM", F.lit(False)) | F.coalesce(F.when(F.size(weights) > 1, F.exists(steps, lambda x: x)), F.lit(False))
    return ~(skewed | uneven | F.coalesce(sign == 1, F.lit(False)))


#: Newton steps, metres by which a position is moved to find its slopes, and a step that ends the search.
STEPS, MOVE, STILL = 10, 0.5, 1e-3


def to_height_by_newton(df: DataFrame, height: float, steps: int = STEPS) -> DataFrame:
    """Adds out_*: where range, range rate and height over the ellipsoid meet, from scp_* on.

    df: scp_*, arp_*, vel_*, range, rate. Slopes are central differences. Each point takes
    its own number of steps. Unrolled, the steps outgrow generated code, so they run over
    Arrow batches.
    """
    a, b = 6378137.0 + height, 6356752.314245 + height
    names = [f"{n}_{k}" for n in ("scp", "arp", "vel") for k in "xyz"] + ["range", "rate"]

    def found(*columns: pd.Series) -> pd.DataFrame:
        values = np.stack([c.to_numpy(float, na_value=np.nan) for c in columns])
        out, arp, vel, distance, rate = values[:3].copy(), values[3:6], values[6:9], values[9], values[10]

        def misses(p: np.ndarray) -> np.ndarray:
            back = p - arp
            size = np.sqrt((back**2).sum(axis=0))
            return np.stack([distance - size, -rate - (vel * back).sum(axis=0) / size, (p[0] ** 2 + p[1] ** 2) / a**2 + p[2] ** 2 / b**2 - 1])

        open_ = np.isfinite(values).all(axis=0)
        out[:, ~open_] = np.nan
        for _ in range(steps):
            if not open_.any():
                break
            slopes = np.stack([(misses(out + MOVE * np.eye(3)[:, k : k + 1]) - misses(out - MOVE * np.eye(3)[:, k : k + 1])) / (2 * MOVE) for k in range(3)], axis=1)
            step = np.zeros_like(out)
            step[:, open_] = np.linalg.solve(slopes[:, :, open_].transpose(2, 0, 1), -misses(out)[:, open_].T[:, :, None])[:, :, 0].T
            out += step
            open_ &= np.abs(step).max(axis=0) > STILL
        return pd.DataFrame({f"out_{k}": out[j] for j, k in enumerate("xyz")})

    place = F.pandas_udf(found, "out_x double, out_y double, out_z double")(*names)
    return df.withColumn("_place", place).select(*df.columns, "_place.*")


def geometry_vectors(df: DataFrame) -> DataFrame:
    """Adds unit vectors of a collection: ground and slant normals, ground range, layover and shadow directions."""
    scp, arp, vel = vec("scp"), vec("arp"), vec("vel")
    los, up, slant = _vec("_los"), _vec("ground"), _vec("slant")
    own = _kept(_kept(df, "_los", (scp - arp).unit()), "ground", normal(scp))
    own = own.withColumn("_look", F.signum(arp.cross(vel).dot(los)))
    own = _kept(own, "slant", (vel.cross(los) * F.col("_look")).unit())
    own = _kept(own, "toward", los.across(up).unit())
    own = _kept(own, "layover", (up - slant * (1 / up.dot(slant))).unit())
    own = _kept(own, "shadow", (los.across(up)).unit())
    return own.drop("_look", *[f"_los_{a}" for a in "xyz"])


def cone_angle(v: Vec, sight: Vec) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.unit().dot(sight)))) * (180 / math.pi)
