"""From posts and official counts to spikes, leads and spillover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import series


def signal_vs_official(posts: DataFrame, official: DataFrame, *, time: str, substance: str, risk: str | None = None, rates: DataFrame | None = None, edges: DataFrame | None = None, max_lag: int = 3, trailing: int = 6) -> dict[str, DataFrame]:
    """The tables signal, spikes, correlations, leads and, with edges, spillover. official is (date, substance, deaths)."""
    signal = series.bin_signal(posts, time=time, keys=[substance], risk=risk).withColumnRenamed(substance, "substance")
    signal = series.fill_gaps(signal, keys=["substance"], value="post_count")
    if rates is not None:
        signal = series.normalize_by_rate(signal, rates, key="substance", value="post_count")
    deaths = official.groupBy(F.trunc("date", "month").alias("period"), "substance").agg(F.sum("deaths").alias("deaths"))
    spikes = series.trailing_z(signal, keys=["substance"], value="post_count", window=trailing).where("is_spike")
    correlations = series.lead_lag(signal, deaths, keys=["substance"], social_value="post_count", official_value="deaths", max_lag=max_lag)
    out = {"signal": signal, "spikes": spikes, "correlations": correlations, "leads": series.best_lead(correlations, keys=["substance"])}
    if edges is not None:
        out["spillover"] = series.spillover(spikes, edges)
    return out


def timeliness(official: DataFrame, alerts: DataFrame, leads: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    """Of spikes in the official counts: ranks of relevant alerts, detection lags, and their summaries."""
    deaths = official.groupBy(F.trunc("date", "month").alias("period"), "substance").agg(F.sum("deaths").alias("deaths"))
    spikes = series.trailing_z(deaths, keys=["substance"], value="deaths").where("is_spike")
    ranks = series.reciprocal_ranks(spikes, alerts, leads, topics)
    lags = series.detection_lag(spikes, alerts)
    return {"ranks": ranks, "mrr": series.mean_reciprocal_rank(ranks), "lags": lags, "lag_summary": series.lag_summary(lags)}
