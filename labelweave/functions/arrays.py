"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.transform(a, lambda x: F.exp(x.cast("double") - top) / total)


def argmax(a: Column) -> Column:
    """0-based index of the largest element, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
