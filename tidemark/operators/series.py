"""Time series: binning, gap filling, rolling scores, lead and lag, co-occurring spikes.

A series is a table with key columns, a period (date or timestamp) and a value. Every window is partitioned by
the keys; the number of periods of one key is bounded by time, not by the rows that were binned into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import pearson_p_value

STEP = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def bin_signal(posts: DataFrame, *, time: str, keys: list[str], unit: str = "month", risk: str | None = None, risks=("medium", "high")) -> DataFrame:
    """(period, keys, post_count): rows a period, of the given risks if a risk column is named. Weeks start on Monday."""
    if risk:
        posts = posts.where(F.col(risk).isin(*risks))
    posts = posts.where(F.col(time).isNotNull())
    for k in keys:
        posts = posts.where(F.col(k).isNotNull())
    return posts.groupBy(F.date_trunc(unit, time).cast("date").alias("period"), *keys).agg(F.count(F.lit(1)).alias("post_count"))


def fill_gaps(series: DataFrame, *, keys: list[str], value: str, period: str = "period", unit: str = "month", fill: float | None = 0) -> DataFrame:
    """Each key's series with a row for every period from its first to its last; missing values become fill."""
    span = series.groupBy(*keys).agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    grid = span.select(*keys, F.explode(F.expr(f"sequence(lo, hi, {STEP[unit]})")).alias(period))
    joined = grid.join(series, [*keys, period], "left")
    return joined if fill is None else joined.withColumn(value, F.coalesce(value, F.lit(fill).cast(series.schema[value].dataType)))


def centered_frame(window: int) -> tuple[int, int]:
    """Row offsets of a centred window: an even one reaches one row further back."""
    return (-(window // 2), window // 2 - 1) if window % 2 == 0 else (-(window - 1) // 2, (window - 1) // 2)


def centered_z(series: DataFrame, *, keys: list[str], value: str, order: str = "period", window: int = 3, threshold: float = 2.0) -> DataFrame:
    """Adds z, against the centred window that includes the row itself, and is_spike.

    The largest possible z in a window of n rows is (n-1)/sqrt(n), so a window of 3 never passes 2.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(*centered_frame(window))
    x = F.col(value).cast("double")
    z = (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))
    return series.withColumn("z", z).withColumn("is_spike", F.coalesce(F.col("z") > threshold, F.lit(False)))


def trailing_z(series: DataFrame, *, keys: list[str], value: str, order: str = "period", window: int = 6, least: int = 2, threshold: float = 1.5) -> DataFrame:
    """Adds z, against the window rows before the row, at least least of them, and is_spike. No look-ahead."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    x = F.col(value).cast("double")
    z = (x - F.avg(x).over(w)) / F.nullif(F.stddev_samp(x).over(w), F.lit(0.0))
    z = F.when(F.count(x).over(w) >= least, z)
    return series.withColumn("z", z).withColumn("is_spike", F.coalesce(F.col("z") > threshold, F.lit(False)))


def global_z(series: DataFrame, *, keys: list[str], value: str, flat: float = 0.0) -> DataFrame:
    """Adds z against the whole series of a key; a series without spread gives flat."""
    w = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    sd = F.stddev_samp(x).over(w)
    return series.withColumn("z", F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(F.lit(flat)))


def lag_by(value: Column, w, k: int) -> Column:
    return F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else value


def lead_lag(social: DataFrame, official: DataFrame, *, keys: list[str], social_value: str, official_value: str, period: str = "period", max_lag: int = 3, least: int = 5, calendar: bool = True, p_values: bool = True) -> DataFrame:
    """(keys, shift_lag, lead_months, n, r[, p]) for shifts from -max_lag to max_lag.

    social[t] is paired with official[t - shift_lag], so lead_months = -shift_lag is how far social is ahead.
    calendar shifts by months; otherwise by rows of the periods that both series have. Fewer than least pairs
    give no row.
    """
    s = social.select(*keys, period, F.col(social_value).cast("double").alias("s"))
    o = official.select(*keys, period, F.col(official_value).cast("double").alias("o"))
    lags = list(range(-max_lag, max_lag + 1))
    if calendar:
        # One official row serves each lag at the period where it is wanted: an equi-join, no range.
        moved = o.select(*keys, "o", F.explode(F.array(*map(F.lit, lags))).alias("shift_lag"), F.col(period).alias("p0"))
        moved = moved.select(*keys, "o", "shift_lag", F.add_months("p0", F.col("shift_lag")).alias(period))
        pairs = s.join(moved, [*keys, period])
    else:
        w = Window.partitionBy(*keys).orderBy(period)
        both = s.join(o, [*keys, period]).where("s IS NOT NULL AND o IS NOT NULL")
        wide = both.select(*keys, "s", F.array(*(F.struct(F.lit(k).alias("shift_lag"), lag_by(F.col("o"), w, k).alias("o")) for k in lags)).alias("v"))
        pairs = wide.select(*keys, "s", F.explode("v").alias("v")).select(*keys, "s", "v.shift_lag", "v.o")
    pairs = pairs.where("s IS NOT NULL AND o IS NOT NULL")
    out = pairs.groupBy(*keys, "shift_lag").agg(F.count(F.lit(1)).alias("n"), F.corr("s", "o").alias("r")).where(F.col("n") >= least)
    out = out.select(*keys, "shift_lag", (-F.col("shift_lag")).alias("lead_months"), "n", "r")
    return out.withColumn("p", pearson_p_value("r", F.col("n"))) if p_values else out


def best_lead(correlations: DataFrame, *, keys: list[str], by: str = "strongest", alpha: float = 0.05, default: int = 0) -> DataFrame:
    """(keys, lead_months): of the significant leads the one with the largest |r| ("strongest") or smallest p ("surest")."""
    significant = correlations.where((F.col("lead_months") > 0) & (F.col("p") < alpha))
    rank = F.struct(F.abs("r"), -F.col("lead_months")) if by == "strongest" else F.struct(-F.col("p"), -F.col("lead_months"))
    best = significant.groupBy(*keys).agg(F.max_by("lead_months", rank).alias("found"))
    return correlations.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("found", F.lit(default)).alias("lead_months"))


def normalize_by_rate(signal: DataFrame, rates: DataFrame, *, key: str, value: str, rate: str = "rate") -> DataFrame:
    """Adds normalized: value / rate * 100 where the key has a positive rate, else the value itself."""
    joined = signal.join(rates.select(key, rate), key, "left")
    return joined.withColumn("normalized", F.when(F.col(rate) > 0, F.col(value) / F.col(rate) * 100).otherwise(F.col(value).cast("double")))


def latest_mean(rates: DataFrame, *, key: str, year: str = "year", value: str = "rate", years: int = 3, digits: int = 4) -> DataFrame:
    """(key, rate): the mean of each key's latest years, rounded."""
    w = Window.partitionBy(key).orderBy(F.desc(year))
    latest = rates.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= years)
    return latest.groupBy(key).agg(F.round(F.avg(value), digits).alias("rate"))


def near_in_time(left: DataFrame, right: DataFrame, *, on: list[str], left_time: str, right_time: str, days: int) -> DataFrame:
    """The pairs of rows with equal on columns and times at most days apart.

    Time is cut into buckets of days; a left row is looked up in its own bucket and both neighbours, so the join
    is by equality and its candidates are a constant factor above the result, whatever the span of time.
    """
    epoch = lambda c: F.datediff(F.to_date(c), F.to_date(F.lit("1970-01-01")))
    bucket = lambda c: F.floor(epoch(c) / max(days, 1))
    a = left.withColumn("__b", F.explode(F.sequence(bucket(left_time) - 1, bucket(left_time) + 1)))
    b = right.withColumn("__b", bucket(right_time))
    return a.join(b, [*on, "__b"]).where(F.abs(F.datediff(left_time, right_time)) <= days).drop("__b")


def spillover(spikes: DataFrame, edges: DataFrame, *, key: str = "substance", period: str = "period", days: int = 35) -> DataFrame:
    """(period, key, related, spillover_flag): for each spike, the neighbours in edges (src, dst) that spike near it."""
    s = spikes.select(F.col(period).alias("period"), F.col(key).alias("src")).distinct()
    asked = s.join(edges.select("src", "dst"), "src").select(F.col("period").alias("t"), "src", F.col("dst").alias("k"))
    other = s.select(F.col("src").alias("k"), F.col("period").alias("u"))
    met = near_in_time(asked, other, on=["k"], left_time="t", right_time="u", days=days)
    related = met.groupBy(F.col("t").alias("period"), "src").agg(F.sort_array(F.collect_set("k")).alias("related"))
    out = s.join(related, ["period", "src"], "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    return out.select("period", F.col("src").alias(key), "related", (F.size("related") > 0).alias("spillover_flag"))


def similarity_edges(matrix: DataFrame, *, threshold: float = 0.70) -> DataFrame:
    """(src, dst, score) of a table (src, scores map) with at least the threshold."""
    return matrix.select("src", F.explode("scores").alias("dst", "score")).where(F.col("score") >= threshold)


def detection_lag(spikes: DataFrame, alerts: DataFrame, *, key: str = "substance", spike_time: str = "period", alert_time: str = "period", before: int = 12, after: int = 3) -> DataFrame:
    """(key, spike_period, alert_period, topic, alert_level, lag_days): each spike's earliest alert from before months
    ahead to after months past it. Alerts meet spikes by the month they fall in: an equi-join over before + after + 1
    months a spike."""
    s = spikes.select(key, F.col(spike_time).alias("spike_period"))
    months = F.sequence(F.lit(-before - 1), F.lit(after + 1))
    asked = s.select(key, "spike_period", F.explode(months).alias("k")).select(key, "spike_period", F.add_months(F.trunc("spike_period", "month"), F.col("k")).alias("m"))
    a = alerts.select(F.col(alert_time).alias("alert_period"), "topic", "alert_level", F.trunc(alert_time, "month").alias("m"))
    inside = (F.col("alert_period") >= F.add_months("spike_period", -before)) & (F.col("alert_period") <= F.add_months("spike_period", after))
    first = asked.join(a, "m").where(inside).groupBy(key, "spike_period").agg(F.min(F.struct("alert_period", "topic", "alert_level")).alias("a"))
    return first.select(key, "spike_period", "a.alert_period", "a.topic", "a.alert_level", F.datediff("a.alert_period", "spike_period").alias("lag_days"))


def lag_summary(lags: DataFrame, *, key: str = "substance") -> DataFrame:
    x = F.col("lag_days")
    return lags.groupBy(key).agg(F.count(x).alias("n"), F.avg(x).alias("mean_lag"), F.percentile(x, F.lit(0.5)).alias("median_lag"), F.min(x).alias("min_lag"), F.max(x).alias("max_lag"))


def reciprocal_ranks(spikes: DataFrame, alerts: DataFrame, leads: DataFrame, topics: DataFrame, *, key: str = "substance", spike_time: str = "period", alert_time: str = "period") -> DataFrame:
    """(key, spike_period, signal_period, rank, reciprocal_rank): where a relevant topic ranks among the alerts, by z,
    of the month lead_months before a spike. leads is (key, lead_months), topics is (key, topic); no hit counts 0."""
    w = Window.partitionBy("m").orderBy(F.desc("z"), "topic")
    ranked = alerts.select(F.trunc(alert_time, "month").alias("m"), "topic", "z_score").groupBy("m", "topic").agg(F.max("z_score").alias("z"))
    ranked = ranked.withColumn("rank", F.row_number().over(w))
    s = spikes.select(key, F.col(spike_time).alias("spike_period")).join(leads, key)
    s = s.withColumn("m", F.add_months(F.trunc("spike_period", "month"), -F.col("lead_months")))
    hits = s.join(topics, key).join(ranked, ["m", "topic"]).groupBy(key, "spike_period").agg(F.min("rank").alias("rank"))
    out = s.join(hits, [key, "spike_period"], "left")
    return out.select(key, "spike_period", F.col("m").alias("signal_period"), "rank", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_reciprocal_rank(ranks: DataFrame, *, key: str = "substance") -> DataFrame:
    return ranks.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("reciprocal_rank").alias("mrr"))
