"""Vectors as arrays: exact cosine and means, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    """0 for zero vectors and unequal lengths; with ``clamp`` within 0 and 1."""
    size = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) if clamp else value


def valid_vector(a: Column, dim: int) -> Column:
    return F.when(F.size(a) == dim, a)


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean by ``keys`` as an array in place order."""
    parts = rows.select(*keys, F.posexplode(vector).alias("__at", "__x"))
    means = parts.groupBy(*keys, "__at").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__at", "__m"))), lambda s: s["__m"])
    return means.groupBy(*keys).agg(ordered.alias(vector))
