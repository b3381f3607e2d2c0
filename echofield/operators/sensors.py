"""What the conversions from sensors' own metadata have in common.

A sensor's product is an XML or JSON text, one row each. Its fields are XPath
projections; the polynomials of the common model are least-squares fits by sums, so the
samples are aggregated by the executors and only a small system is solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grouped
from .formation import fitted_polynomial


#: In no XML document, so it parts the fields that one expression returns.
PARTED = "\uffff"
#: Fields of one expression; Java refuses one of more than 100 operators.
TOGETHER = 3


def xml_fields(products: DataFrame, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds fields given as (XPath, type); a missing element gives null.

    Paths that use local-name() work with any namespace. A text is parsed once for
    some fields: one expression returns how many nodes each path has and the first one's text.
    Lists of several nodes are asked for by themselves; so are all fields of a text with CDATA
    sections, which ``xpath`` takes for nodes of their own.
    """
    if len(fields) > TOGETHER or any(sum(map(path.count, "/|[(=@")) > 12 for path, _ in fields.values()):
        if len(fields) == 1:
            ((name, (path, kind)),) = fields.items()
            values = F.xpath(F.col(text), F.lit(path if path.endswith("text()") or "/@" in path else f"{path}/text()"))
            return products.withColumn(name, _numbers(F.array_join(values, " "), kind[6:-1]) if kind.startswith("array<") else F.get(values, 0).try_cast(kind))
        names, size = list(fields), TOGETHER if len(fields) > TOGETHER else 1
        for k in range(0, len(names), size):
            products = xml_fields(products, text, {x: fields[x] for x in names[k : k + size]})
        return products
    if not fields:
        return products
    paths = {name: path if path.endswith("text()") or "/@" in path else f"{path}/text()" for name, (path, _) in fields.items()}
    apart = f", '{PARTED}', "
    both = apart.join(f"count({x}){apart}string({x})" for x in paths.values())
    sections = F.contains(F.col(text), F.lit("<![CDATA["))
    # The array is a column of its own, as an expression that is used twice might be evaluated twice.
    parts = F.split(F.when(~sections, F.xpath_string(F.col(text), F.lit(f"concat({both})"))), PARTED)
    out = {}
    for k, (name, (_, kind)) in enumerate(fields.items()):
        many, first = F.get("_parts", F.lit(2 * k)).cast("int"), F.get("_parts", F.lit(2 * k + 1))
        values = F.xpath(F.col(text), F.lit(paths[name]))
        if kind.startswith("array<"):
            out[name] = _numbers(F.when(sections | (many > 1), F.array_join(values, " ")).otherwise(first), kind[6:-1])
        else:
            out[name] = F.when(sections, F.get(values, 0)).when(many > 0, first).try_cast(kind)
    return products.withColumn("_parts", parts).withColumns(out).drop("_parts")


def _numbers(text: Column, kind: str) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast(kind))


def json_fields(products: DataFrame, text: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds fields given as (path, type)."""
    return products.withColumns({name: F.get_json_object(F.col(text), path).try_cast(kind) for name, (path, kind) in fields.items()})


def position_polynomial(states: DataFrame, order_limit: int = 8) -> list[list[float]]:
    """Polynomials of x, y and z over t; states has t, x, y, z.

    The order rises while that halves the error at least.
    """
    n = states.count()
    best, last = None, None
    for order in range(2, min(order_limit, n - 1) + 1):
        fits = fitted_polynomial(states, "t", ["x", "y", "z"], order)
        miss = sum((F.col(a) - _horner(c, F.col("t"))) ** 2 for a, c in zip("xyz", fits, strict=True))
        error = states.agg(F.sqrt(F.avg(miss))).first()[0]
        if last is not None and error > last / 2:
            break
        best, last = fits, error
    return best or fitted_polynomial(states, "t", ["x", "y", "z"], max(n - 1, 0))


def _horner(coefficients: list[float], x: Column) -> Column:
    total = F.lit(0.0)
    for c in reversed(coefficients):
        total = total * x + c
    return total


def surface_polynomial(samples: DataFrame, x: str, y: str, value: str, order_x: int, order_y: int) -> list[list[float]]:
    """Least-squares coefficients [m][n] of x**m * y**n."""
    terms = [(m, n) for m in range(order_x + 1) for n in range(order_y + 1)]
    sx, sy = (samples.agg(F.coalesce(F.max(F.abs(c)), F.lit(1.0))).first()[0] or 1.0 for c in (x, y))
    u, v = F.col(x) / sx, F.col(y) / sy
    monomial = lambda m, n: F.pow(u, F.lit(float(m))) * F.pow(v, F.lit(float(n)))
    powers = sorted({(a[0] + b[0], a[1] + b[1]) for a in terms for b in terms})
    sums = samples.agg(*[F.sum(monomial(*p)).alias(f"s{p[0]}_{p[1]}") for p in powers], *[F.sum(monomial(*t) * F.col(value)).alias(f"b{t[0]}_{t[1]}") for t in terms]).first()
    matrix = np.array([[sums[f"s{a[0] + b[0]}_{a[1] + b[1]}"] for b in terms] for a in terms])
    found = np.linalg.lstsq(matrix, np.array([sums[f"b{m}_{n}"] for m, n in terms]), rcond=None)[0]
    out = np.zeros((order_x + 1, order_y + 1))
    for (m, n), c in zip(terms, found, strict=True):
        out[m, n] = c / sx**m / sy**n
    return out.tolist()


def constant_calibration(tables: DataFrame, key: str, values: str) -> DataFrame:
    """(key, beta0): 1 / value**2 where a product's table holds one value only, else null."""
    low, high = F.array_min(values), F.array_max(values)
    each = tables.groupBy(key).agg(F.min(low).alias("low"), F.max(high).alias("high"))
    return each.select(key, F.when(F.col("low") == F.col("high"), 1 / (F.col("low") * F.col("low"))).alias("beta0"))


def noise_fits(vectors: DataFrame, key: str, pixels: str, values: str, order: int = 6) -> DataFrame:
    """key, db_poly: for each burst the polynomial of its noise table in decibels over range pixels.

    All bursts are one grouped fit; see ``grouped``.
    """
    pair = F.arrays_zip(F.col(pixels).alias("p"), F.col(values).alias("v"))
    each = vectors.select(key, F.explode(pair).alias("s")).select(key, F.col("s.p").cast("double").alias("p"), (10 * F.log10("s.v")).alias("db"))
    return grouped.polynomials(each, [key], "p", ["db"], order)


def noise_polynomials(vectors: DataFrame, key: str, pixels: str, values: str, order: int = 6) -> dict:
    """``noise_fits`` of one product, as lists by burst."""
    return {x[key]: list(x["db_poly"]) for x in noise_fits(vectors, key, pixels, values, order).collect()}


def bursts(products: DataFrame, lines: str, per_burst: str) -> DataFrame:
    """A row for each burst, with its first line."""
    number = F.explode(F.sequence(F.lit(0), F.ceil(F.col(lines) / F.col(per_burst)).cast("int") - 1))
    return products.withColumn("burst", number).withColumn("first_line", F.col("burst") * F.col(per_burst))
