"""From an image back to the aperture that made it.

The image's spectrum lies on a rectangle of wavenumbers, azimuth u by range v. The largest
part of an annulus within it is resampled to rays: first along u, to equal angles (each
line of one v by itself), then along each ray, to equal radii. Between the two lines are
turned once, so a task holds lines only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import in_polygon
from .spectral import on_lines, on_numbered_lines, transformed_2d, turned, unpacked


@dataclass(frozen=True)
class Wavenumbers:
    """The rectangle of an image of n_u lines and n_v samples, and the annulus within it.

    spacing and bandwidth are those of azimuth and range; the bandwidth leaves out zeros
    that pad the spectrum.
    """

    n_u: int
    n_v: int
    centre: float
    spacing: tuple[float, float]
    bandwidth: tuple[float, float] | None = None

    @property
    def first_u(self) -> float:
        return -0.5 / self.spacing[0]

    @property
    def step_u(self) -> float:
        return 1 / self.spacing[0] / max(self.n_u - 1, 1)

    @property
    def first_v(self) -> float:
        return self.centre - 0.5 / self.spacing[1]

    @property
    def step_v(self) -> float:
        return 1 / self.spacing[1] / max(self.n_v - 1, 1)

    @property
    def angle(self) -> float:
        """Half the angle that the annulus spans."""
        used = self.bandwidth or (1 / self.spacing[0], 1 / self.spacing[1])
        return math.asin(used[0] / 2 / (self.centre + used[1] / 2))

    @property
    def radii(self) -> tuple[float, float]:
        used = self.bandwidth or (1 / self.spacing[0], 1 / self.spacing[1])
        return (self.centre - used[1] / 2) / math.cos(self.angle), self.centre + used[1] / 2

    def angles(self) -> np.ndarray:
        return np.linspace(-self.angle, self.angle, self.n_u)

    def radius(self) -> np.ndarray:
        return np.linspace(*self.radii, self.n_v)


def _between(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lines at places between their samples, linearly; zero beyond them."""
    n = z.shape[1]
    low = np.clip(np.floor(at), 0, max(n - 2, 0)).astype(np.int64)
    share = at - low
    value = np.take_along_axis(z, low, 1) * (1 - share) + np.take_along_axis(z, np.minimum(low + 1, n - 1), 1) * share
    return np.where((at >= 0) & (at <= n - 1), value, 0)


def spectrum(lines: DataFrame, k: Wavenumbers, sign: int = -1) -> DataFrame:
    """Lines of the centred spectrum, by azimuth wavenumber; of the image's energy."""
    scale = math.sqrt(k.n_u * k.n_v) if sign < 0 else 1 / math.sqrt(k.n_u * k.n_v)
    return on_lines(transformed_2d(lines, sign), lambda z: z / scale)


def inverse_polar(lines: DataFrame, k: Wavenumbers, sign: int = -1) -> DataFrame:
    """Lines by angle, with samples by radius, of an image's lines by azimuth."""
    angles, radius = k.angles(), k.radius()

    def keystone(numbers: np.ndarray, z: np.ndarray) -> np.ndarray:
        v = k.first_v + numbers * k.step_v
        return _between(z, (np.tan(angles) * v[:, None] - k.first_u) / k.step_u)

    def radial(numbers: np.ndarray, z: np.ndarray) -> np.ndarray:
        return _between(z, (radius * np.cos(angles[numbers])[:, None] - k.first_v) / k.step_v)

    return on_numbered_lines(turned(on_numbered_lines(turned(spectrum(lines, k, sign)), keystone)), radial)


def box_corners(k: Wavenumbers, angles: tuple[int, int], radii: tuple[int, int], points: int = 10) -> list[tuple[float, float]]:
    """A box of rays and radii as a polygon of places in the spectrum, lines and samples."""
    a, r = k.angles(), k.radius()
    a0, a1, r0, r1 = a[angles[0]], a[angles[1]], r[radii[0]], r[radii[1]]
    along = np.linspace(0, 1, points)
    sides = [(a0 + 0 * along, r0 + (r1 - r0) * along), (a0 + (a1 - a0) * along, r1 + 0 * along), (a1 + 0 * along, r1 + (r0 - r1) * along), (a1 + (a0 - a1) * along, r0 + 0 * along)]
    angle, radius = (np.concatenate(x) for x in zip(*sides, strict=True))
    u, v = (radius * np.sin(angle) - k.first_u) / k.step_u, (radius * np.cos(angle) - k.first_v) / k.step_v
    return list(zip(u.tolist(), v.tolist(), strict=True))


def masked(lines: DataFrame, corners: list[tuple[float, float]], outside: bool = False) -> DataFrame:
    """Long form of a spectrum's lines with zeros outside a polygon, or inside it."""
    inside = in_polygon(F.col("r"), F.col("c"), corners)
    kept = ~inside if outside else inside
    return unpacked(lines).select("r", "c", *(F.when(kept, F.col(n)).otherwise(0.0).alias(n) for n in ("re", "im")))
