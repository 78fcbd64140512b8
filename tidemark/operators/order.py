"""Ranks of values that are too many to be sorted in one task.

Values are counted first, so that only distinct ones are left. A distinct value lies in a bucket, which grows with the
value whatever the data are: a thousand buckets for each factor of two. Running sums are taken over the buckets of a
key, of which there are a bounded number, and within each bucket, so that no task sees all values of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor of two.
FINENESS = 1024


def bucket(value: Column) -> Column:
    """A number that never falls as the value grows; null for null. Not-a-number is above all others."""
    x = value.cast("double")
    place = F.floor(F.log2(F.abs(x)) * FINENESS).cast("long") + F.lit(1 << 21)
    tiny, infinite = F.abs(x) < 1e-300, F.abs(x) == float("inf")
    size = F.when(tiny, F.lit(0).cast("long")).when(infinite, F.lit(1 << 23).cast("long")).otherwise(place)
    return F.when(F.isnan(x), F.lit(1 << 24).cast("long")).when(x < 0, -size).otherwise(size)


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str], *, down: bool = False) -> DataFrame:
    """counts, one row a distinct value of a key, with before_<c> and all_<c> for each column c of sums: its sum over
    the key's smaller values (larger ones if down), and over all."""
    order = F.desc if down else F.asc
    rows = counts.withColumn("__b", bucket(F.col(value)))
    within = Window.partitionBy(*keys, "__b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*(keys or [F.lit(1)]))
    parts = rows.groupBy(*keys, "__b").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    parts = parts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__pb"),
        *[F.coalesce(F.sum(f"__s_{c}").over(over), F.lit(0)).alias(f"__o_{c}") for c in sums], *[F.sum(f"__s_{c}").over(everything).alias(f"all_{c}") for c in sums],
    )
    same = [F.col("__b") == F.col("__pb"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]]
    met = rows.withColumns({f"__w_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(parts, same)
    return met.select(*counts.columns, *[(F.col(f"__w_{c}") + F.col(f"__o_{c}")).alias(f"before_{c}") for c in sums], *[f"all_{c}" for c in sums])


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, __x, __n): the distinct values of a column and how often each occurs.

    The value comes out as a maximum of its group: a filter on a result of an aggregation stays above it, while one on
    what rows are grouped by would be pushed down to the rows, with the whole expression of the value once more.
    """
    return rows.select(*keys, F.col(value).alias("__g")).groupBy(*keys, "__g").agg(F.max("__g").alias("__x"), F.count(F.lit(1)).alias("__n")).drop("__g")


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, <name>...): the exact quantiles of a value, linear between neighbours; nulls and not-a-numbers don't count."""
    return counted_quantiles(counted(rows, keys, value), keys, wanted)


def counted_quantiles(counts: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """quantiles() of what counted() gives."""
    x = F.col("__x").cast("double")
    counts = counts.select(*keys, x.alias("__x"), "__n").where(x.isNotNull() & ~F.isnan(x))
    placed = running(counts, keys, "__x", ["__n"])
    at = {name: F.lit(float(q)) * (F.col("all___n") - 1) for name, q in wanted.items()}
    # The rows ranked from before to before + n - 1 have the value; the least one that reaches a rank holds it.
    reach = lambda rank: F.min(F.when(F.col("before___n") + F.col("__n") > rank, F.col("__x")))
    ends = [f(reach(g(at[name]))) for name in wanted for f, g in ((lambda c, n=name: c.alias(f"__lo_{n}"), F.floor), (lambda c, n=name: c.alias(f"__hi_{n}"), F.ceil))]
    parts = [F.max(at[name] - F.floor(at[name])).alias(f"__f_{name}") for name in wanted]
    found = placed.groupBy(*keys).agg(*ends, *parts)
    between = lambda n: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")
    return found.select(*keys, *[between(n).alias(n) for n in wanted])
