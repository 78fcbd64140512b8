"""Fusion of several classifiers' verdicts by weighted vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config

SOURCES = ("rule", "embedding", "llm", "finetuned")


def one_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows with a usable key, one of each: the first by order, or by all columns."""
    usable = df.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "") & (F.lower(F.col(key).cast("string")) != "nan"))
    rest = [c for c in ([order] if order else []) + [c for c in df.columns if c != key]]
    return usable.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in df.columns if c != key])


def merge_verdicts(rule: DataFrame, embedding: DataFrame, llm: DataFrame | None = None, finetuned: DataFrame | None = None, *, key: str = "post_id") -> DataFrame:
    """One row a key with <source>_risk_level and <source>_confidence: rule and embedding by full outer join, the
    others by left join. Each input is (key, risk_level, confidence); an absent one gives null columns."""
    named = lambda df, s: df.select(key, F.col("risk_level").alias(f"{s}_risk_level"), F.col("confidence").alias(f"{s}_confidence"))
    out = named(rule, "rule").join(named(embedding, "embedding"), key, "full_outer")
    for name, df in (("llm", llm), ("finetuned", finetuned)):
        if df is not None:
            out = out.join(named(df, name), key, "left")
        else:
            out = out.withColumns({f"{name}_risk_level": F.lit(None).cast("string"), f"{name}_confidence": F.lit(None).cast("double")})
    return out


def _weight(source: str) -> Column:
    """The source's weight by which optional sources have a verdict in the row; null where it has none itself."""
    llm, ft = F.col("llm_risk_level").isNotNull(), F.col("finetuned_risk_level").isNotNull()
    out = None
    for there, weights in config.VOTE_WEIGHTS.items():
        if source not in weights:
            continue
        case = (llm if "llm" in there else ~llm) & (ft if "finetuned" in there else ~ft)
        out = F.when(case, weights[source]) if out is None else out.when(case, weights[source])
    return F.when(F.col(f"{source}_risk_level").isNotNull(), out)


def vote(merged: DataFrame, *, cuts=config.VOTE_CUTS) -> DataFrame:
    """Adds final_risk_level, ensemble_score, ensemble_confidence, method_agreement and sources_used.

    Levels count 0, 1, 2; weights are renormalised over the sources that have a verdict. The score is low below
    the first cut and medium below the second. Confidence is the mean over those sources, .5 where one has none.
    A single source agrees with itself; without any the verdict is low, 0, false and "".
    """
    rank = lambda s: F.when(F.col(f"{s}_risk_level") == "high", 2).when(F.col(f"{s}_risk_level") == "medium", 1).when(F.col(f"{s}_risk_level") == "low", 0)
    zero = F.lit(0.0)
    total = sum((F.coalesce(_weight(s), zero) for s in SOURCES), zero)
    score = sum((F.coalesce(_weight(s) * rank(s), zero) for s in SOURCES), zero) / F.nullif(total, zero)
    here = [F.when(F.col(f"{s}_risk_level").isNotNull(), F.struct(F.lit(s).alias("s"), F.col(f"{s}_risk_level").alias("l"), F.coalesce(f"{s}_confidence", F.lit(0.5)).cast("double").alias("c"))) for s in SOURCES]
    votes = F.filter(F.array(*here), lambda v: v.isNotNull())
    n = F.size(votes)
    confidence = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v["c"]) / F.nullif(n, F.lit(0))
    out = merged.withColumn("ensemble_score", F.round(score, 6))
    return out.withColumns(
        {
            "final_risk_level": F.when(F.coalesce(F.col("ensemble_score"), zero) < cuts[0], "low").when(F.col("ensemble_score") < cuts[1], "medium").otherwise("high"),
            "ensemble_confidence": F.round(F.round(F.coalesce(confidence, zero), 9), 3),
            "method_agreement": F.size(F.array_distinct(F.transform(votes, lambda v: v["l"]))) == 1,
            "sources_used": F.array_join(F.array_sort(F.transform(votes, lambda v: v["s"])), "+"),
        }
    )


def compare_methods(a: DataFrame, b: DataFrame, *, key: str = "post_id", names=("rule", "embedding")) -> DataFrame:
    """(key, <a>_risk, <b>_risk, agree) of the keys that both have, one row each; unusable keys are left out."""
    left = one_per_key(a.select(key, "risk_level"), key).withColumnRenamed("risk_level", f"{names[0]}_risk")
    right = one_per_key(b.select(key, "risk_level"), key).withColumnRenamed("risk_level", f"{names[1]}_risk")
    return left.join(right, key).withColumn("agree", F.col(f"{names[0]}_risk") == F.col(f"{names[1]}_risk"))
