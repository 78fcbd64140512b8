"""From embedded posts to drift, topics, alerts, evidence and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import decide, narrative


def narrative_evolution(posts: DataFrame, anchors: dict[str, list[float]], *, time: str, vector: str, risk: str, unit: str = "week", least_posts: int = 10, correlations: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables windows, topics, rising, report, trajectory and recommendations."""
    windows = narrative.drift(narrative.window_centroids(posts, time=time, vector=vector, risk=risk, unit=unit, least_posts=least_posts))
    mix = narrative.window_composition(posts, time=time, risk=risk, unit=unit, least_posts=least_posts)
    windows = windows.join(mix, "period")
    topics = narrative.topic_prevalence(posts, anchors, time=time, vector=vector, unit=unit)
    rising = narrative.rising_topics(narrative.melt_topics(topics))
    report = narrative.warning_report(rising, correlations)
    return {
        "windows": windows, "topics": topics, "rising": rising, "report": report,
        "trajectory": narrative.trajectory_label(windows.drop("centroid", "high_centroid"), report), "recommendations": decide.recommendations(report),
    }
