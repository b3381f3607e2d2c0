"""Polynomials with ascending coefficients in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polyval(coefficients: Column, x: Column) -> Column:
    """Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda total, c: total * x + c)


def chebyshev(coefficients: Column, u: Column) -> Column:
    """The series of Chebyshev polynomials at u in [-1, 1], by Clenshaw's rule."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    step = lambda s, c: F.struct((c + 2 * u * s["a"] - s["b"]).alias("a"), s["a"].alias("b"), s["b"].alias("c"))
    return F.aggregate(F.reverse(coefficients), start, step, lambda s: s["a"] - u * s["b"])


def polyval2d(coefficients: Column, x: Column, y: Column) -> Column:
    """The sum of coefficients[m][n] * x**m * y**n."""
    return F.aggregate(F.reverse(F.transform(coefficients, lambda row: polyval(row, y))), F.lit(0.0), lambda total, c: total * x + c)


def derivative(coefficients: Column) -> Column:
    times = F.transform(coefficients, lambda c, k: c * k)
    return F.when(F.size(coefficients) > 1, F.slice(times, F.lit(2), F.size(coefficients) - 1)).otherwise(F.array(F.lit(0.0)))


def integral(coefficients: Column) -> Column:
    return F.concat(F.array(F.lit(0.0)), F.transform(coefficients, lambda c, k: c / (k + 1)))


def product(a: Column, b: Column) -> Column:
    """Coefficients of the product of two polynomials."""
    n = F.size(a) + F.size(b) - 1
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.aggregate(
            F.sequence(F.greatest(F.lit(0), k - F.size(b) + 1), F.least(k, F.size(a) - 1)),
            F.lit(0.0),
            lambda total, i: total + F.get(a, i) * F.get(b, k - i),
        ),
    )


def shifted(coefficients: Column, by: Column) -> Column:
    """Coefficients of p(x + by), by Horner's rule on polynomials: q becomes q * (x + by) + c."""

    def step(q: Column, c: Column) -> Column:
        times_x, times_by = F.concat(F.array(c), q), F.concat(F.transform(q, lambda v: v * by), F.array(F.lit(0.0)))
        return F.zip_with(times_x, times_by, lambda a, b: a + b)

    doubles = F.transform(coefficients, lambda c: c.cast("double"))
    return F.aggregate(F.reverse(doubles), F.array().cast("array<double>"), step)
