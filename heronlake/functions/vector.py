"""Vector expressions: cosine and centroid, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where a norm is 0, null where an input is null or lengths differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def unit(a: Column) -> Column:
    """*a* over its norm (null if that is 0), so that a dot product is a cosine."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key.  Positions are averaged separately, so partial sums are merged before the shuffle."""
    cells = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("_p", "_x"))
    means = cells.groupBy(key, "_p").agg(F.avg("_x").alias("_x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias("centroid"))
