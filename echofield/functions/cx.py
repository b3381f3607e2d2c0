"""Complex arithmetic on pairs of Columns. Spark has no complex type."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Cx(NamedTuple):
    re: Column
    im: Column

    def __mul__(self, other: Cx | Column | float) -> Cx:  # type: ignore[override]
        if isinstance(other, Cx):
            return Cx(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)
        return Cx(self.re * other, self.im * other)

    def __add__(self, other: Cx) -> Cx:  # type: ignore[override]
        return Cx(self.re + other.re, self.im + other.im)

    def __sub__(self, other: Cx) -> Cx:
        return Cx(self.re - other.re, self.im - other.im)

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def angle(self) -> Column:
        return F.atan2(self.im, self.re)


def cx(re: str = "re", im: str = "im") -> Cx:
    return Cx(F.col(re), F.col(im))


def unit(angle: Column) -> Cx:
    """exp(j angle)."""
    return Cx(F.cos(angle), F.sin(angle))


def decibels(power: Column) -> Column:
    return 10 * F.log10(power)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison between engines; never a negative zero."""
    return F.round(value, digits) + F.lit(0.0)
