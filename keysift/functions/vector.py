"""Vector functions over array columns, in double precision."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import let

FLOOR = 1e-12


def constant(values: Sequence[float]) -> Column:
    """The values as one literal array: written as text and folded, so that a plan doesn't carry an expression for each."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """The rows as one literal array of arrays."""
    return F.from_json(F.lit(json.dumps([[float(v) for v in row] for row in rows])), "array<array<double>>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return let(F.greatest(norm(a), F.lit(FLOOR)), lambda n: F.transform(a, lambda x: x.cast("double") / n))  # one norm for all values


def cosine01(unit_a: Column, unit_b: Column) -> Column:
    """The cosine of two unit vectors, from 0 to 1."""
    return (F.least(F.greatest(dot(unit_a, unit_b), F.lit(-1.0)), F.lit(1.0)) + 1) / 2


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def valid(a: Column) -> Column:
    """Whether a vector has a finite norm that isn't zero."""
    n = norm(a)
    return ~F.isnan(n) & (n > FLOOR) & (n < float("inf"))


def mean_by(df: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, mean): the element-wise mean of each group, in one aggregation that combines before the shuffle."""
    means = F.array(*[F.avg(F.get(column, F.lit(i)).cast("double")) for i in range(size)])
    return df.groupBy(key).agg(means.alias("mean"))


def half_even_ms(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("long")


def linspace_positions(rows: int, sample: int) -> Column:
    """``sample`` positions spread evenly from 0 to ``rows`` - 1, truncated, as an array."""
    n = min(rows, sample)
    if n <= 0:
        return F.array().cast("array<bigint>")
    if n == 1:
        return F.array(F.lit(0).cast("long"))
    step = (rows - 1) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.lit(step) + F.lit(1e-9)))
