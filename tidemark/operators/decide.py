"""Decisions and the tables that a dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import counted, counted_quantiles


def recommendations(report: DataFrame, *, states: str = "Unknown", lead_months: int = 3) -> DataFrame:
    """(period, topic, severity, recommendation, rationale) of a warning report: two rows for a critical alert, one
    for others."""
    # The texts of severities, recommendations and rationales.
    topic, level = F.col("topic"), F.col("alert_level")
    pct = F.coalesce(F.col("pct_increase"), F.lit(0.0)).cast("string")
    row = lambda severity, text, why: F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("recommendation"), why.alias("rationale"))
    critical = F.array(
        row("IMMEDIATE", f"Deploy naloxone in top-3 states by death rate ({states})", F.concat(F.lit("Critical "), topic, F.lit(" alert detected."))),
        row("IMMEDIATE", f"Activate early warning protocol {lead_months} months before projected spike", F.lit(f"Social signal leads CDC deaths by {lead_months} months.")),
    )
    harm = lambda severity: F.array(row(severity, "Increase harm reduction outreach messaging", F.concat(F.lit("Rising harm_reduction topic ("), pct, F.lit("% increase)."))))
    elevated = F.array(row("MONITOR", "Monitor local community forums and alert local health officials", F.concat(F.lit("Elevated "), topic, F.lit(" signals ("), pct, F.lit("% increase)."))))
    watch = F.array(row("INFORMATIONAL", "Track topic trajectory in dashboard", F.concat(F.lit("Watch "), topic, F.lit(" signals ("), pct, F.lit("% increase)."))))
    is_harm = topic == "harm_reduction"
    rows = (
        F.when(level == "critical", critical)
        .when(is_harm & (level == "watch"), harm("INFORMATIONAL"))
        .when(is_harm & (level == "elevated"), harm("MONITOR"))
        .when(level == "elevated", elevated)
        .when(level == "watch", watch)
    )
    return report.select("period", "topic", F.explode(rows).alias("r")).select("period", "topic", "r.severity", "r.recommendation", "r.rationale")


def top_states(official: DataFrame, *, substance: str | None = None, year: int | None = None, value: str = "deaths", k: int = 3) -> DataFrame:
    """(state, mean_value): the k states with the highest mean; the limit is the feature."""
    rows = official.where(F.col("state").isNotNull() & F.col(value).isNotNull())
    if substance is not None:
        rows = rows.where(F.col("substance") == substance)
    if year is not None:
        rows = rows.where(F.year("date") == year)
    return rows.groupBy("state").agg(F.avg(value).alias("mean_value")).orderBy(F.desc("mean_value"), "state").limit(k)


def window_kpis(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count(F.lit(1)).alias("n_windows"), F.sum(F.col("is_drift_event").cast("int")).alias("n_events"), F.max("drift_score").alias("max_drift"), F.avg("pct_high").alias("mean_pct_high"))


def alert_kpis(report: DataFrame) -> DataFrame:
    return report.groupBy("alert_level").agg(F.count(F.lit(1)).alias("n"))


def most_flagged_topic(report: DataFrame) -> DataFrame:
    return report.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(1)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def most_common(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column, n): the most common value of each group, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), column)
    return counts.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def posts_in_windows(posts: DataFrame, windows: DataFrame, *, time: str, least: int = 5) -> DataFrame:
    """Rows of posts with the start of each window [start, end) that they fall in; of windows with fewer than least
    posts none. Windows are joined by day, so the candidates of a post are the windows of its day."""
    days = windows.select("start", "end", F.explode(F.expr("sequence(start, end - INTERVAL 1 DAY, INTERVAL 1 DAY)")).alias("__d"))
    days = days.select("start", F.col("__d").cast("date").alias("__d")).distinct()
    hit = posts.withColumn("__d", F.to_date(time)).join(days, "__d").drop("__d")
    n = hit.groupBy("start").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return hit.join(n, "start", "left_semi")


def evidence_records(candidates: DataFrame, *, keys: list[str], id_col: str, text: str, risk: str, least: int = 3, show: int = 5, length: int = 120) -> DataFrame:
    """One record a key from its ranked candidates (rank, similarity): majority risk, a confidence from the first
    similarities scaled to their range, and the first distinct snippets. Keys with fewer than least have none."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("similarity").over(w), F.max("similarity").over(w)
    scaled = F.when(hi > lo, (F.col("similarity") - lo) / (hi - lo)).otherwise(1.0)
    rows = candidates.withColumns({"__s": scaled, "__t": F.trim(F.substring(text, 1, length))})
    votes = most_common(rows, keys, risk).select(*keys, F.col(risk).alias("inferred_risk"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "__t", id_col))), lambda x: x["__t"])
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("rank") <= show, F.col("__s"))), 6).alias("confidence"), F.slice(F.array_distinct(listed), 1, show).alias("evidence"))
    return out.where(F.col("n") >= least).join(votes, keys, "left")


def retrieval_query(summary: DataFrame, *, substance: str, risk: str) -> DataFrame:
    """Adds query, the text that a spike's evidence is looked up by."""
    return summary.withColumn("query", F.format_string("%s use with %s risk: relapse, withdrawal, overdose", F.coalesce(substance, F.lit("substance")), F.coalesce(risk, F.lit("moderate"))))


def month_context(official: DataFrame, windows: DataFrame, *, time: str = "start") -> DataFrame:
    """windows with top_substance and top_deaths: the official count that is largest in the window's month."""
    month = official.groupBy(F.trunc("period", "month").alias("__m")).agg(F.max_by("substance", F.struct("deaths", "substance")).alias("top_substance"), F.max("deaths").alias("top_deaths"))
    return windows.withColumn("__m", F.trunc(time, "month")).join(month, "__m", "left").drop("__m")


def spike_summaries(posts: DataFrame, *, keys: list[str], substance: str, risk: str) -> DataFrame:
    """(keys, n_posts, substance, pct_high, inferred_risk): what a spike's posts have in common. The risk is the most
    common one; where no post has a risk it follows from the share of high ones, and is moderate without posts."""
    out = posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"), F.avg((F.col(risk) == "high").cast("double")).alias("pct_high"))
    out = out.join(most_common(posts, keys, substance).drop("n"), keys, "left").join(most_common(posts, keys, risk).drop("n").withColumnRenamed(risk, "__r"), keys, "left")
    by_share = F.when(F.col("pct_high") >= 0.10, "high").when(F.col("pct_high") >= 0.04, "medium").when(F.col("pct_high").isNotNull(), "low").otherwise("moderate")
    return out.withColumn("inferred_risk", F.coalesce("__r", by_share)).drop("__r")


def spike_prompts(ranked: DataFrame, *, keys: list[str], text: str, posts: int = 15, length: int = 200) -> DataFrame:
    """(keys, prompt): the first posts of each spike, cut to a length, for a summarising model. Both limits are its budget."""
    top = ranked.where(F.col("rank") <= posts)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring(text, 1, length).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"]))
    return top.groupBy(*keys).agg(F.concat(F.lit("Summarise the common theme of these posts:\n"), F.array_join(lines, "\n")).alias("prompt"))


def flat_correlations(correlations: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    return correlations.withColumn("significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def best_significant_lag(correlations: DataFrame, *, key: str = "substance", alpha: float = 0.05) -> DataFrame:
    """(key, shift_lag, r): each key's significant lag with the largest r."""
    best = correlations.where(F.col("p") < alpha).groupBy(key).agg(F.max(F.struct("r", "shift_lag")).alias("b"))
    return best.select(key, "b.shift_lag", "b.r")


def earliest_median_lag(summary: DataFrame, *, key: str = "substance") -> DataFrame:
    """The key whose median lag is the most negative, if any is."""
    return summary.where("median_lag < 0").orderBy("median_lag", key).limit(1).select(key, "median_lag")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, stddev, min, quartiles and max of a column, as one row. Quartiles are exact, and no task sorts all
    values. All come from the counts of distinct values, so that the column is computed once."""
    counts = counted(df, [], column)
    x, n = F.col("__x").cast("double"), F.when(F.col("__x").isNotNull(), F.col("__n"))
    one = counts.agg(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("n"), (F.sum(x * n) / F.sum(n)).alias("mean"), F.min("__x").alias("min"), F.max("__x").alias("max"))
    off = counts.crossJoin(F.broadcast(one.select("mean"))).agg(F.sum((x - F.col("mean")) * (x - F.col("mean")) * n).alias("__ss"), F.sum(n).alias("__all"))
    std = off.select(F.when(F.col("__all") > 1, F.sqrt(F.col("__ss") / (F.col("__all") - 1))).alias("std"))
    marks = counted_quantiles(counts.withColumn("__one", F.lit(1)), ["__one"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return one.crossJoin(std).withColumn("__one", F.lit(1)).join(marks, "__one", "left").select("n", "mean", "std", "min", "q25", "q50", "q75", "max")


def first_existing(df: DataFrame, names: list[str]) -> str:
    """The first of the names that is a column, for texts that come under several names."""
    return next(n for n in names if n in df.columns)
