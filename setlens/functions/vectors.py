"""Vector and score expressions in double precision, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def mean_of_top(values: Column, k: int) -> Column:
    """Mean of the k largest values, of all if there are fewer."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x) / F.size(top)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def slope(offset: Column, size: Column) -> Column:
    return (offset / size) * (offset / size)
