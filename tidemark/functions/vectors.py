"""Vector functions over array columns, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is null or has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str) -> Column:
    n = F.nullif(norm(a), F.lit(0.0))
    return F.transform(_doubles(a), lambda x: x / n)


def centroids(df: DataFrame, keys: list[str], vector: str, *, least_rows: int = 1) -> DataFrame:
    """(keys, n, centroid): the mean vector of each group of at least least_rows rows.

    Vectors are exploded by place and averaged with partial aggregation, so a group of any size sends one row
    a place and task; only the means of one group, as many as there are dimensions, meet in a row.
    """
    places = df.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(_doubles(vector)).alias("__place", "__x"))
    means = places.groupBy(*keys, "__place").agg(F.avg("__x").alias("__mean"), F.count(F.lit(1)).alias("__n"))
    ordered = F.array_sort(F.collect_list(F.struct("__place", "__mean")))
    out = means.groupBy(*keys).agg(F.max("__n").alias("n"), ordered["__mean"].alias("centroid"))
    return out.where(F.col("n") >= least_rows)
