"""Vector arithmetic on arrays of floats, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_vector(c: Column) -> Column:
    return c.cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector; fails on vectors of different lengths."""
    size = norm(a) * norm(b)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return checked.otherwise(F.when(size == 0, 0.0).otherwise(dot(a, b) / size))
