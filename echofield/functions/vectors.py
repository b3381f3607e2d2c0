"""Vectors of three Columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def __add__(self, other: Vec) -> Vec:  # type: ignore[override]
        return Vec(self.x + other.x, self.y + other.y, self.z + other.z)

    def __sub__(self, other: Vec) -> Vec:
        return Vec(self.x - other.x, self.y - other.y, self.z - other.z)

    def __mul__(self, by: Column | float) -> Vec:  # type: ignore[override]
        return Vec(self.x * by, self.y * by, self.z * by)

    def dot(self, other: Vec) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, other: Vec) -> Vec:
        return Vec(self.y * other.z - self.z * other.y, self.z * other.x - self.x * other.z, self.x * other.y - self.y * other.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        return self * (1 / self.norm())

    def across(self, normal: Vec) -> Vec:
        """The part that is perpendicular to a unit vector."""
        return self - normal * self.dot(normal)


def vec(prefix: str) -> Vec:
    return Vec(F.col(f"{prefix}_x"), F.col(f"{prefix}_y"), F.col(f"{prefix}_z"))


def rotated(v: Vec, axis: Vec, angle: Column) -> Vec:
    """v turned about a unit axis (Rodrigues' formula)."""
    c, s = F.cos(angle), F.sin(angle)
    return v * c + axis.cross(v) * s + axis * (axis.dot(v) * (1 - c))
