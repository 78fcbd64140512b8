"""Mixing sources to target weights.

One aggregate gives each source's words. Targets come from its closed form: a source gets its cap where the
cap is below its share of what is left, taken in order of cap over weight; all others share the rest by weight.
The rate is the target over the source's words. A document is emitted floor(rate) times, and once more if a
number drawn from the hash of a seed and its id lies below the fraction of the rate. Independent draws leave a
source of few or very uneven documents some percent off its target, so a second aggregate sums the words that each
of a few seeds would take, and every source keeps the seed that comes nearest. No rows are sorted or shuffled for it.

The choice among seeds is a bias: over a source of many documents a copy still has nearly the probability of the
fraction, but over a source of a few the choice comes close to rounding its size, so that a document that alone makes up
its source is repeated if that comes nearer to the target, whatever its fraction. With tries=1 each draw is independent
and its probability exactly the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, checkpointed, small, text_or_empty

SIZE, KEY = "__mix_size", "__mix_source"

#: Seeds that each source chooses from.
TRIES = 16


def words_in(text_col: str) -> Column:
    """Words of a text as a long; 0 for a null text."""
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def draw(id_col: str, seed: str, number: Column) -> Column:
    """A number in [0, 1) from the md5 of seed, number and id: the same in every run and on every engine."""
    text = F.concat(F.lit(f"{seed}:"), number.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, *, cycle: int = 3, cap: int = 3) -> DataFrame:
    """(KEY, source_size, target, rate) of a table (KEY, SIZE).

    Weights are 1 to cycle, repeating over the sources by code point, null last. There is one row a source, so
    the two windows over all sources hold as many rows as there are sources, not documents.
    """
    totals = sizes.groupBy(KEY).agg(F.sum(SIZE).alias("source_size"))
    ranked = totals.withColumn("w", (F.row_number().over(Window.orderBy(F.col(KEY).asc_nulls_last())) - 1) % cycle + 1)
    # By cap over weight; the product with 6 keeps the order of the fractions exact for the default cycle.
    order = Window.orderBy((F.col("source_size") * F.lit(_multiple(cycle)) / F.col("w")).asc(), F.col(KEY).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = ranked.withColumns(
        {
            "rest": F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
            "w_rest": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    # The first source in the order that is not capped fixes the share of all that follow.
    free = F.when(F.col("source_size") * cap * F.col("w_rest") > F.col("w") * F.col("rest"), F.struct("w_rest", "rest"))
    level = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.coalesce(
        (F.col("w") * level["rest"]).cast("double") / level["w_rest"].cast("double"), (F.col("source_size") * cap).cast("double")
    )
    return left.select(KEY, "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def _multiple(cycle: int) -> int:
    from math import lcm

    return lcm(*range(1, cycle + 1))


NAMES = {"size": SIZE, "source_size": "__mix_total", "target": "__mix_target", "copies": "__mix_copies"}


def _planned(docs: DataFrame, *, cycle: int = 3, cap: int = 3, seed: str = "mix", tries: int = TRIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with the plan under the internal names of NAMES."""
    sized = docs.withColumns({SIZE: words_in(text_col), KEY: F.col(source_col)})
    targets = checkpointed(source_targets(sized.select(KEY, SIZE), cycle=cycle, cap=cap))
    targets = targets.select(F.col(KEY).alias("__mix_key"), F.col("source_size").alias("__mix_total"), F.col("target").alias("__mix_target"), F.col("rate").alias("__mix_rate"))
    whole = F.floor("__mix_rate")
    fraction = F.col("__mix_rate") - whole
    met = lambda sources: sized.join(small(sources), F.col(KEY).eqNullSafe(F.col("__mix_key")), "left")
    taken = [F.sum(F.when(draw(id_col, seed, F.lit(k)) < fraction, F.col(SIZE)).otherwise(0)).alias(f"__mix_{k}") for k in range(tries)]
    sums = met(targets).groupBy("__mix_key").agg(*taken).withColumnRenamed("__mix_key", "__mix_same")
    off = lambda k: F.abs(F.col("__mix_total") * whole + F.col(f"__mix_{k}") - F.col("__mix_target"))
    nearest = F.array_min(F.array(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(tries)]))["k"]
    chosen = targets.join(sums, F.col("__mix_key").eqNullSafe(F.col("__mix_same"))).withColumn("__mix_seed", nearest)
    chosen = checkpointed(chosen.select("__mix_key", "__mix_total", "__mix_target", "__mix_rate", "__mix_seed"))
    copies = whole + F.when(draw(id_col, seed, F.col("__mix_seed")) < fraction, 1).otherwise(0)
    return met(chosen).withColumn("__mix_copies", copies.cast("long")).select(*docs.columns, *NAMES.values())


def mixing_plan(docs: DataFrame, **options) -> DataFrame:
    """docs with four more columns: size, source_size, target (of the source) and copies.

    Options: cycle and cap of the targets, seed, tries (seeds that a source chooses from), id_col, text_col, source_col. Columns of docs that have the
    four names are replaced. A null text has size 0. A null source is a source of its own, the last. A null id draws
    as the empty text; repeated rows draw alike. Where no source has words, targets and copies are 0. An empty table
    gives an empty one. No source is moved to one task: sizes are summed on the map side, and the sources join by
    broadcast if they are counted and few, else by a shuffle that adaptive execution splits.
    """
    plan = _planned(docs, **options)
    return plan.select(*[c for c in docs.columns if c not in NAMES], *[F.col(inner).alias(c) for c, inner in NAMES.items()])


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its plan says, with exactly the columns of docs."""
    rows = _planned(docs, **options).where("__mix_copies > 0")
    repeated = F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))).alias("__mix_copy")
    return rows.select(*docs.columns, repeated).select(*docs.columns)
