"""Vectors in arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: what a lambda takes from outside it would be anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one of them is zero."""
    return let(F.struct(dot(a, b).alias("d"), (norm(a) * norm(b)).alias("n")), lambda p: F.when(p["n"] > 0, p["d"] / p["n"]).otherwise(0.0))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    scaled = lambda v, n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
    return let(doubles(a), lambda v: let(norm(v), lambda n: scaled(v, n)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def upper_triangle(matrix: Column) -> Column:
    """Elements above the diagonal, row by row; empty for a null matrix."""
    rows = F.transform(matrix, lambda row, i: F.filter(row, lambda _, j: j > i))
    return F.coalesce(F.flatten(rows), F.array().cast("array<double>"))


def others_of(row: Column, position: Column) -> Column:
    """A row of a matrix without the element on the diagonal."""
    return F.filter(row, lambda _, j: j != position)


def triangle_of_others(rows: Column) -> Column:
    """The upper triangle, from rows that lack the element on the diagonal."""
    return F.coalesce(F.flatten(F.transform(rows, lambda row, i: F.filter(row, lambda _, j: j >= i))), F.array().cast("array<double>"))


def mean(values: Column) -> Column:
    """Mean of an array, null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n)


def top_mean(values: Column, k: Column | int | None) -> Column:
    """Mean of the ``k`` largest values (all for 0 or null), 0 if there are none."""
    ordered = F.sort_array(doubles(values), asc=False)
    k = F.coalesce(k if isinstance(k, Column) else F.lit(k).cast("int"), F.lit(0))
    return F.coalesce(mean(F.when(k > 0, F.slice(ordered, F.lit(1), k)).otherwise(ordered)), F.lit(0.0))
