"""How what is said changes over time: drift of windows' centroids, topics, rising topics, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.vectors import centroids, cosine
from tidemark.operators.order import quantiles
from tidemark.operators.series import global_z


def window_composition(posts: DataFrame, *, time: str, risk: str, substances: str | None = None, unit: str = "week", least_posts: int = 10, top: int = 3) -> DataFrame:
    """(period, post_count, pct_high, pct_medium, pct_low[, substances map of the top ones by posts])."""
    rows = posts.where(F.col(time).isNotNull()).withColumn("period", F.date_trunc(unit, time).cast("date"))
    share = lambda level: F.avg((F.col(risk) == level).cast("double")).alias(f"pct_{level}")
    out = rows.groupBy("period").agg(F.count(F.lit(1)).alias("post_count"), *map(share, ("high", "medium", "low"))).where(F.col("post_count") >= least_posts)
    if not substances:
        return out
    counts = rows.select("period", F.explode(substances).alias("s")).groupBy("period", "s").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("period").orderBy(F.desc("n"), "s")
    best = counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top)
    maps = best.groupBy("period").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("substances"))
    return out.join(maps, "period", "left")


def window_centroids(posts: DataFrame, *, time: str, vector: str, risk: str | None = None, unit: str = "week", least_posts: int = 10, least_risk: int = 3) -> DataFrame:
    """(period, n, centroid[, high_centroid]): mean vectors of windows of at least least_posts posts."""
    rows = posts.where(F.col(time).isNotNull()).withColumn("period", F.date_trunc(unit, time).cast("date"))
    out = centroids(rows, ["period"], vector, least_rows=least_posts)
    if risk:
        high = centroids(rows.where(F.col(risk) == "high"), ["period"], vector, least_rows=least_risk)
        out = out.join(high.select("period", F.col("centroid").alias("high_centroid")), "period", "left")
    return out


def drift(windows: DataFrame, *, threshold: float = 2.0) -> DataFrame:
    """Adds drift_score (1 - cosine to the window before, 4 places), cumulative_drift, drift_direction, z, is_drift_event.

    The direction is toward_risk if this centroid is nearer than the last one to the last window's high-risk
    centroid, unknown without one; the first window has nulls. There is one row a period, so the windows over all
    periods are small.
    """
    w = Window.orderBy("period")
    before, high = F.lag("centroid").over(w), F.lag("high_centroid").over(w)
    out = windows.withColumns({"__p": before, "__h": high})
    out = out.withColumn("drift_score", F.round(1 - cosine("centroid", "__p"), 4))
    nearer = cosine("centroid", "__h") > cosine("__p", "__h")
    direction = F.when(F.col("__p").isNull(), None).when(nearer.isNull(), "unknown").when(nearer, "toward_risk").otherwise("away_from_risk")
    out = out.withColumn("drift_direction", direction).drop("__p", "__h")
    out = out.withColumn("cumulative_drift", F.round(F.sum(F.coalesce("drift_score", F.lit(0.0))).over(w), 4))
    out = global_z(out.withColumn("__all", F.lit(1)), keys=["__all"], value="drift_score").drop("__all")
    return out.withColumn("is_drift_event", F.coalesce(F.col("z") > threshold, F.lit(False)))


def topic_prevalence(posts: DataFrame, anchors: dict[str, list[float]], *, time: str, vector: str, unit: str = "week", share_above: float = 0.45, least_posts: int = 1) -> DataFrame:
    """(period, post_count, <topic>_score, <topic>_pct): the 75th percentile of posts' cosine to a topic's anchor
    vector, and the share above share_above. The percentile is exact; a window of any size is never in one task."""
    rows = posts.where(F.col(time).isNotNull() & F.col(vector).isNotNull()).withColumn("period", F.date_trunc(unit, time).cast("date"))
    sims = {t: F.round(cosine(vector, F.array(*[F.lit(float(x)) for x in v])), 9).alias(t) for t, v in anchors.items()}
    scored = rows.select("period", *sims.values())
    shares = [F.avg((F.col(t) > share_above).cast("double")).alias(f"{t}_pct") for t in anchors]
    out = scored.groupBy("period").agg(F.count(F.lit(1)).alias("post_count"), *shares).where(F.col("post_count") >= least_posts)
    if not anchors:
        return out
    long = scored.select("period", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(t).alias("x")) for t in anchors])).alias("s")).select("period", "s.t", "s.x")
    marks = quantiles(long, ["period", "t"], "x", {"q": 0.75}).groupBy("period").agg(*[F.max(F.when(F.col("t") == t, F.col("q"))).alias(f"{t}_score") for t in anchors])
    return out.join(marks, "period", "left").select("period", "post_count", *[f"{t}{end}" for t in anchors for end in ("_score", "_pct")])


def melt_topics(topics: DataFrame, *, suffix: str = "_score", name: str = "topic", value: str = "score") -> DataFrame:
    """(period, topic, score): the wide table of topics in long form."""
    columns = [c for c in topics.columns if c.endswith(suffix)]
    long = topics.unpivot("period", columns, name, value)
    return long.withColumn(name, F.replace(F.col(name), F.lit(suffix), F.lit("")))


def rising_topics(topics: DataFrame, *, key: str = "topic", value: str = "score", window: int = 4, threshold: float = 1.5, least_spread: float = 0.001) -> DataFrame:
    """(period, topic, z_score, pct_increase): rows that rise threshold deviations above the window rows before them.

    The first window rows of a topic and baselines that hardly vary are skipped.
    """
    w = Window.partitionBy(key).orderBy("period")
    base = w.rowsBetween(-window, -1)
    mean, sd = F.avg(value).over(base), F.stddev_samp(value).over(base)
    out = topics.withColumns({"__m": mean, "__s": sd, "__k": F.row_number().over(w)})
    out = out.where((F.col("__k") > window) & (F.col("__s") >= least_spread))
    out = out.withColumns({"z_score": F.round((F.col(value) - F.col("__m")) / F.col("__s"), 6), "pct_increase": F.round(100 * (F.col(value) - F.col("__m")) / F.nullif(F.col("__m"), F.lit(0.0)), 1)})
    return out.where(F.col("z_score") >= threshold).select("period", key, "z_score", "pct_increase")


def alert_level(z: str = "z_score") -> Column:
    return F.when(F.col(z) >= 3, "critical").when(F.col(z) >= 2, "elevated").otherwise("watch")


def warning_report(rising: DataFrame, correlations: DataFrame | None = None, *, topic: str = "topic", alpha: float = 0.05) -> DataFrame:
    """rising with alert_level and lead_lag, a phrase on the topic's best significant lead, if any."""
    out = rising.withColumn("alert_level", alert_level())
    if correlations is None:
        return out.withColumn("lead_lag", F.lit("no significant lead"))
    best = correlations.where((F.col("lead_months") > 0) & (F.col("p") < alpha)).groupBy(topic).agg(F.max_by(F.struct("lead_months", "r"), F.struct("r", -F.col("lead_months"))).alias("b"))
    text = F.format_string("leads by %d months (r=%.2f)", F.col("b.lead_months"), F.col("b.r"))
    return out.join(best, topic, "left").withColumn("lead_lag", F.when(F.col("b").isNotNull(), text).otherwise("no significant lead")).drop("b")


def trajectory_label(windows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Adds label: drift event, else the period's topic of highest z, else a high share of risk, else the count."""
    top = alerts.groupBy("period").agg(F.max_by("topic", F.struct("z_score", "topic")).alias("__t"))
    label = (
        F.when(F.col("is_drift_event"), F.concat(F.lit("drift: "), F.coalesce("drift_direction", F.lit("unknown"))))
        .when(F.col("__t").isNotNull(), F.concat(F.lit("rising: "), F.col("__t")))
        .when(F.col("pct_high") > 0.4, F.format_string("high risk %.0f%%", 100 * F.col("pct_high")))
        .otherwise(F.concat(F.col("post_count").cast("string"), F.lit(" posts")))
    )
    return windows.join(top, "period", "left").withColumn("label", label).drop("__t")


def trajectory_2d(windows: DataFrame, *, vector: str = "centroid") -> DataFrame:
    """Adds x and y, the first two principal components of the windows' centroids (a linear stand-in for a
    neighbour embedding)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = windows.withColumn("__v", array_to_vector(vector))
    out = PCA(k=2, inputCol="__v", outputCol="__p").fit(rows).transform(rows).withColumn("__a", vector_to_array("__p"))
    return out.withColumns({"x": F.col("__a")[0], "y": F.col("__a")[1]}).drop("__v", "__p", "__a")


def spike_periods(windows: DataFrame, *, most: int = 12) -> DataFrame:
    """(start, end, drift_score): drift events, or where there are none the windows of most drift, latest first;
    the limit is the feature."""
    event = F.max(F.col("is_drift_event").cast("int")).over(Window.partitionBy(F.lit(1)))
    rows = windows.withColumn("__e", event).where((F.col("__e") == 0) | F.col("is_drift_event"))
    top = rows.orderBy(F.desc_nulls_last("drift_score"), "period").limit(most)
    return top.select(F.col("period").alias("start"), F.expr("period + INTERVAL 7 DAYS").cast("date").alias("end"), "drift_score").orderBy(F.desc("start"))


def monthly_high_spikes(posts: DataFrame, *, time: str, risk: str, threshold: float = 1.5, most: int = 8) -> DataFrame:
    """(start, end, n, z): months in which high-risk posts stand out; [first of the month, first of the next)."""
    months = posts.where((F.col(risk) == "high") & F.col(time).isNotNull()).groupBy(F.date_trunc("month", time).cast("date").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    out = global_z(months.withColumn("__all", F.lit(1)), keys=["__all"], value="n").drop("__all").where(F.col("z") > threshold)
    return out.withColumn("end", F.add_months("start", 1)).orderBy(F.desc("n"), "start").limit(most)
