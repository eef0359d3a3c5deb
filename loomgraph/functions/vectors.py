"""Vector arithmetic on array columns, as higher-order functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(a: Column) -> Column:
    """a over its length; null for a vector of zeros."""
    return F.when(norm(a) > 0, scaled(a, 1 / norm(a)))


def orthogonal(a: Column, *bases: Column) -> Column:
    """What is left of a without its parts along orthonormal bases (a step of Gram-Schmidt)."""
    for b in bases:
        a = added(a, scaled(b, -dot(a, b)))
    return a


def applied(matrix: Column, a: Column) -> Column:
    """A matrix, an array of rows, times a vector."""
    return F.transform(matrix, lambda row: dot(row, a))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays taken as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))
