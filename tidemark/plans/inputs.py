"""The joined inputs of the analyses. All joins are by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import readers


def classifier_outputs(spark: SparkSession, base: str) -> dict[str, DataFrame | None]:
    """rule and embedding verdicts, which must be there, and llm and finetuned ones, which may. Without an llm table the
    rows of the hybrid one that were really routed to the model stand in for it."""
    read = lambda name: spark.read.parquet(f"{base}/{name}")
    out = {"rule": read("rule_based_results"), "embedding": read("embedding_results")}
    for name in ("llm", "finetuned"):
        out[name] = read(f"{name}_results") if readers.exists(spark, f"{base}/{name}_results") else None
    if out["llm"] is None and readers.exists(spark, f"{base}/hybrid_results"):
        out["llm"] = read("hybrid_results").where("routing = 'llm'")
    return out


def analysis_inputs(posts: DataFrame, verdicts: DataFrame, embeddings: DataFrame, *, key: str = "post_id") -> DataFrame:
    """Posts that have a verdict and an embedding."""
    return posts.join(verdicts.select(key, F.col("final_risk_level").alias("risk_level")), key).join(embeddings.select(key, "embedding"), key)


def cluster_inputs(embeddings: DataFrame, clusters: DataFrame, verdicts: DataFrame, *, key: str = "post_id", noise: int = -1) -> DataFrame:
    """Embedded posts with a cluster, but for the noise cluster, and a verdict."""
    rows = embeddings.where("embedding IS NOT NULL").join(clusters.select(key, "cluster").where(F.col("cluster") != noise), key)
    return rows.join(verdicts.select(key, "final_risk_level").where("final_risk_level IS NOT NULL"), key)


def training_inputs(verdicts: DataFrame, texts: DataFrame, *, key: str = "post_id", text: str = "text") -> DataFrame:
    """(key, text, risk_level) of verdicts with a known level and a text of more than ten characters."""
    rows = verdicts.where(F.col("final_risk_level").isin("low", "medium", "high")).join(texts.select(key, F.trim(text).alias(text)), key)
    return rows.where(F.length(text) > 10).select(key, text, F.col("final_risk_level").alias("risk_level"))
