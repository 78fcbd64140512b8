"""The query catalogue: each entry runs operators over whole tables, with SQL that must give the same rows.

The tables play the roles of the data model: events are posts with a substance and a time, lineitem and orders are
monthly social and official counts, documents, pages and conversations are texts, labels their truth, embeddings the
vectors of posts. Doubles are rounded, so that the order of a sum cannot decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import clusters, decide, ensemble, knn, metrics, narrative, rules, series
from tidemark.plans import risk as risk_plan
from tidemark.session import spread
from tidemark.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- roles ---------------------------------------------------------------------------------------------------


def posts(spark, d) -> DataFrame:
    level = F.when(F.col("value") >= 100, "high").when(F.col("value") >= 30, "medium").otherwise("low")
    return table(spark, d, "events").select(F.col("event_id").alias("post_id"), "ts", F.col("event_type").alias("substance"), "value", "props", level.alias("risk"))


POSTS = """posts AS (
  SELECT event_id AS post_id, ts, event_type AS substance, value, props,
    CASE WHEN value >= 100 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS risk
  FROM events)"""


def official(spark, d) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("date")
    return table(spark, d, "orders").groupBy(month.alias("period"), F.col("o_orderpriority").alias("substance")).agg(F.round(F.sum("o_totalprice"), 2).alias("deaths"))


OFFICIAL = """official AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderpriority AS substance, round(sum(o_totalprice), 2) AS deaths
  FROM orders GROUP BY 1, 2)"""


def social(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return series.bin_signal(lines.select(F.col("l_shipdate").alias("t"), F.col("o_orderpriority").alias("substance")), time="t", keys=["substance"])


SOCIAL = """social AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, o_orderpriority AS substance, count(*) AS post_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def vectors(spark, d) -> DataFrame:
    """Embeddings as posts: risk by label, a day for each vec_id in a month of 28."""
    level = F.element_at(F.array(*map(F.lit, config.RISKS)), F.col("label") % 3 + 1)
    time = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 84).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label", level.alias("risk"), time.alias("t"))


VECTORS = """vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label, ['low', 'medium', 'high'][label % 3 + 1] AS risk,
    DATE '2024-01-01' + CAST(vec_id % 84 AS INTEGER) AS t
  FROM embeddings), sized AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM vectors)"""

#: Words of the corpus that stand in for a domain's vocabulary, which these texts do not have.
LEXICON = {"thnt": "alpha", "ther": "alpha", "onst": "beta", "in the": "beta", "für": "gamma", "les": "delta", "des": "delta"}
SIGNALS = {"first": ["idiot", "moron", "and the"], "second": ["the of", "loser", "en la"], "third": ["zu", "queau"]}
HIGH, DISTRESS = ("idiot", "moron", "scum", "worthless"), ("the of", "and the", "loser", "eine", "para")
WEIGHTS = {"alpha": 0.9, "beta": 0.55, "gamma": 0.3}
GROUPS = {"marks": (0.95, (r"!!", r"\?\?")), "tables": (0.8, (r" \| ", r"\$\$\$")), "pairs": (0.4, (r"\b(the|of) (and|to)\b",))}


# --- series --------------------------------------------------------------------------------------------------


@query("signal_weekly", f"""WITH {POSTS}
SELECT CAST(date_trunc('week', ts) AS DATE) AS period, substance, count(*) AS post_count
FROM posts WHERE risk IN ('medium', 'high') GROUP BY 1, 2""")
def signal_weekly(spark, d):
    return series.bin_signal(posts(spark, d), time="ts", keys=["substance"], unit="week", risk="risk")


FLAGSHIP = f"""WITH {POSTS}, b AS (
  SELECT CAST(date_trunc('day', ts) AS DATE) AS period, substance, count(*) AS post_count
  FROM posts WHERE risk IN ('medium', 'high') GROUP BY 1, 2
), span AS (SELECT substance, min(period) AS lo, max(period) AS hi FROM b GROUP BY 1
), grid AS (SELECT substance, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM span
), f AS (SELECT substance, period, coalesce(post_count, 0) AS post_count FROM grid LEFT JOIN b USING (substance, period)
), s AS (
  SELECT *, count(post_count) OVER w AS n, avg(post_count) OVER w AS m, stddev_samp(post_count) OVER w AS sd FROM f
  WINDOW w AS (PARTITION BY substance ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT substance, period, post_count, CASE WHEN n >= 2 THEN round((post_count - m) / nullif(sd, 0), 6) END AS z,
  coalesce(n >= 2 AND (post_count - m) / nullif(sd, 0) > 1.5, false) AS is_spike
FROM s"""


@query("signal_spikes_trailing", FLAGSHIP)
def signal_spikes_trailing(spark, d):
    binned = series.bin_signal(posts(spark, d), time="ts", keys=["substance"], unit="day", risk="risk")
    filled = series.fill_gaps(binned, keys=["substance"], value="post_count", unit="day")
    return series.trailing_z(filled, keys=["substance"], value="post_count").withColumn("z", r6("z"))


@query("signal_monthly_gapfilled", f"""WITH {SOCIAL}, span AS (SELECT substance, min(period) AS lo, max(period) AS hi FROM social GROUP BY 1
), grid AS (SELECT substance, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM span)
SELECT substance, period, coalesce(post_count, 0) AS post_count FROM grid LEFT JOIN social USING (substance, period)""")
def signal_monthly_gapfilled(spark, d):
    return series.fill_gaps(social(spark, d), keys=["substance"], value="post_count")


@query("spike_centered_z", f"""WITH {OFFICIAL}, s AS (
  SELECT *, avg(deaths) OVER w AS m, stddev_samp(deaths) OVER w AS sd FROM official
  WINDOW w AS (PARTITION BY substance ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING))
SELECT period, substance, deaths, round((deaths - m) / nullif(sd, 0), 6) AS z, coalesce((deaths - m) / nullif(sd, 0) > 2, false) AS is_spike FROM s""")
def spike_centered_z(spark, d):
    return series.centered_z(official(spark, d), keys=["substance"], value="deaths", window=12).withColumn("z", r6("z"))


@query("spike_centered_z_small", f"""WITH {OFFICIAL}, s AS (
  SELECT *, avg(deaths) OVER w AS m, stddev_samp(deaths) OVER w AS sd FROM official
  WINDOW w AS (PARTITION BY substance ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT period, substance, round((deaths - m) / nullif(sd, 0), 6) AS z, false AS is_spike FROM s""")
def spike_centered_z_small(spark, d):
    return series.centered_z(official(spark, d), keys=["substance"], value="deaths", window=3).select("period", "substance", r6("z").alias("z"), "is_spike")


TRAILING = """tz AS (
  SELECT *, count(deaths) OVER w AS n, avg(deaths) OVER w AS m, stddev_samp(deaths) OVER w AS sd FROM official
  WINDOW w AS (PARTITION BY substance ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
), spikes AS (SELECT period, substance FROM tz WHERE n >= 2 AND (deaths - m) / nullif(sd, 0) > 1.5)"""


def official_spikes(spark, d) -> DataFrame:
    return series.trailing_z(official(spark, d), keys=["substance"], value="deaths").where("is_spike").select("period", "substance")


@query("spike_trailing_z", f"WITH {OFFICIAL}, {TRAILING} SELECT period, substance FROM spikes")
def spike_trailing_z(spark, d):
    return official_spikes(spark, d)


@query("global_z", f"""WITH {OFFICIAL} SELECT period, substance,
  round((deaths - avg(deaths) OVER w) / nullif(stddev_samp(deaths) OVER w, 0), 6) AS z
FROM official WINDOW w AS (PARTITION BY substance)""")
def global_z(spark, d):
    return series.global_z(official(spark, d), keys=["substance"], value="deaths").select("period", "substance", r6("z").alias("z"))


LEAD_LAG = f"""WITH {OFFICIAL}, {SOCIAL}, span AS (SELECT substance, min(period) AS lo, max(period) AS hi FROM social GROUP BY 1
), grid AS (SELECT substance, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM span
), filled AS (SELECT substance, period, coalesce(post_count, 0) AS s FROM grid LEFT JOIN social USING (substance, period)
), lags AS (SELECT unnest(generate_series(-3, 3)) AS shift_lag
), pairs AS (
  SELECT f.substance, shift_lag, f.s, o.deaths AS o FROM filled f CROSS JOIN lags
  JOIN official o ON o.substance = f.substance AND o.period = CAST(f.period - to_months(CAST(shift_lag AS INTEGER)) AS DATE)
), cors AS (
  SELECT substance, CAST(shift_lag AS INTEGER) AS shift_lag, CAST(-shift_lag AS INTEGER) AS lead_months, count(*) AS n, corr(s, o) AS r
  FROM pairs GROUP BY 1, 2, 3 HAVING count(*) >= 5)"""


def correlations(spark, d, **options) -> DataFrame:
    filled = series.fill_gaps(social(spark, d), keys=["substance"], value="post_count")
    return series.lead_lag(filled, official(spark, d), keys=["substance"], social_value="post_count", official_value="deaths", **options)


@query("lead_lag_corr", LEAD_LAG + " SELECT substance, shift_lag, lead_months, n, round(r, 6) AS r FROM cors")
def lead_lag_corr(spark, d):
    return correlations(spark, d, p_values=False).withColumn("r", r6("r"))


@query("lead_lag_by_rows", f"""WITH {OFFICIAL}, {SOCIAL}, both_ AS (
  SELECT substance, period, post_count AS s, deaths AS o FROM social JOIN official USING (substance, period)
), u AS ({" UNION ALL ".join(f"SELECT substance, {k} AS shift_lag, s, lag(o, {k}) OVER (PARTITION BY substance ORDER BY period) AS o FROM both_" for k in range(-3, 4))})
SELECT substance, shift_lag, -shift_lag AS lead_months, count(*) AS n, round(corr(s, o), 6) AS r FROM u WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""")
def lead_lag_by_rows(spark, d):
    rows = series.lead_lag(social(spark, d), official(spark, d), keys=["substance"], social_value="post_count", official_value="deaths", calendar=False, p_values=False)
    return rows.withColumn("r", r6("r"))


#: Student's t with n - 2 degrees of freedom has a finite series in the cosine of its angle, whose sine is |r|.
P_VALUES = LEAD_LAG + """, ps AS (
  SELECT *, CASE WHEN r IS NULL OR isnan(r) THEN NULL WHEN n % 2 = 0 THEN greatest(0, 1 - abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(1 - r * r, k))))
    ELSE greatest(0, 1 - 2 / pi() * (asin(abs(r)) + coalesce(abs(r) * list_sum(list_transform(range(0, (n - 3) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(1 - r * r, k + 0.5))), 0))) END AS p
  FROM cors)"""


@query("lead_lag_p", P_VALUES + " SELECT substance, shift_lag, lead_months, n, round(r, 6) AS r, round(p, 6) AS p FROM ps")
def lead_lag_p(spark, d):
    """Correlations with p-values; tests also hold these against an independent integration of the t density."""
    return correlations(spark, d).withColumns({"r": r6("r"), "p": r6("p")})


BEST = P_VALUES + """, best AS (
  SELECT substance, lead_months FROM ps WHERE lead_months > 0 AND p < 0.05 QUALIFY row_number() OVER (PARTITION BY substance ORDER BY abs(r) DESC, lead_months) = 1)"""


@query("best_lead", BEST + " SELECT substance, coalesce(max(best.lead_months), 0) AS lead_months FROM (SELECT DISTINCT substance FROM ps) LEFT JOIN best USING (substance) GROUP BY 1")
def best_lead(spark, d):
    return series.best_lead(correlations(spark, d), keys=["substance"])


EDGES = """edges(src, dst, score) AS (VALUES ('1-URGENT', '2-HIGH', 0.9), ('2-HIGH', '1-URGENT', 0.9), ('1-URGENT', '5-LOW', 0.75),
  ('3-MEDIUM', '5-LOW', 0.8), ('5-LOW', '3-MEDIUM', 0.8), ('4-NOT SPECIFIED', '3-MEDIUM', 0.4))"""


def edges(spark) -> DataFrame:
    rows = [("1-URGENT", {"2-HIGH": 0.9, "5-LOW": 0.75}), ("2-HIGH", {"1-URGENT": 0.9}), ("3-MEDIUM", {"5-LOW": 0.8}), ("5-LOW", {"3-MEDIUM": 0.8}), ("4-NOT SPECIFIED", {"3-MEDIUM": 0.4})]
    return series.similarity_edges(spark.createDataFrame(rows, "src string, scores map<string,double>"))


@query("similarity_edges", f"WITH {EDGES} SELECT src, dst, CAST(score AS DOUBLE) AS score FROM edges WHERE score >= 0.7")
def similarity_edges(spark, d):
    return edges(spark)


@query("spillover_range_join", f"""WITH {OFFICIAL}, {TRAILING}, {EDGES}, met AS (
  SELECT DISTINCT a.period, a.substance, b.substance AS k FROM spikes a JOIN edges e ON e.src = a.substance AND e.score >= 0.7
  JOIN spikes b ON b.substance = e.dst AND abs(date_diff('day', a.period, b.period)) <= 35)
SELECT s.period, s.substance, coalesce(string_agg(k, ',' ORDER BY k), '') AS related, count(k) > 0 AS spillover_flag
FROM spikes s LEFT JOIN met USING (period, substance) GROUP BY s.period, s.substance""")
def spillover_range_join(spark, d):
    return series.spillover(official_spikes(spark, d), edges(spark)).withColumn("related", F.array_join("related", ","))


def alerts(spark, d) -> DataFrame:
    """Rising line statuses as topics: a month's count against the four months before."""
    lines = table(spark, d, "lineitem").select(F.col("l_shipdate").alias("t"), F.concat_ws("_", "l_returnflag", "l_linestatus").alias("topic"))
    counts = series.bin_signal(lines, time="t", keys=["topic"]).withColumn("score", F.col("post_count").cast("double"))
    return narrative.rising_topics(counts).withColumn("alert_level", narrative.alert_level())


ALERTS = """counts AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag || '_' || l_linestatus AS topic, count(*) AS score
  FROM lineitem GROUP BY 1, 2
), base AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY period) AS k, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd FROM counts
  WINDOW w AS (PARTITION BY topic ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
), scored AS (SELECT *, round((score - m) / sd, 6) AS z_score FROM base WHERE k > 4 AND sd >= 0.001
), alerts AS (
  SELECT period, topic, z_score, round(100 * (score - m) / nullif(m, 0), 1) AS pct_increase,
    CASE WHEN z_score >= 3 THEN 'critical' WHEN z_score >= 2 THEN 'elevated' ELSE 'watch' END AS alert_level
  FROM scored WHERE z_score >= 1.5)"""


@query("rising_topics", f"WITH {ALERTS} SELECT period, topic, z_score, alert_level FROM alerts")
def rising_topics(spark, d):
    return alerts(spark, d).select("period", "topic", "z_score", "alert_level")


LAGS = f"""WITH {OFFICIAL}, {TRAILING}, {ALERTS}, near AS (
  SELECT s.substance, s.period AS spike_period, a.period AS alert_period, a.topic, a.alert_level,
    row_number() OVER (PARTITION BY s.substance, s.period ORDER BY a.period, a.topic, a.alert_level) AS k
  FROM spikes s JOIN alerts a ON a.period BETWEEN CAST(s.period - INTERVAL 12 MONTH AS DATE) AND CAST(s.period + INTERVAL 3 MONTH AS DATE)
), lags AS (
  SELECT substance, spike_period, alert_period, topic, alert_level, CAST(date_diff('day', spike_period, alert_period) AS INTEGER) AS lag_days FROM near WHERE k = 1)"""


@query("detection_lag_range_join", LAGS + " SELECT * FROM lags")
def detection_lag_range_join(spark, d):
    return series.detection_lag(official_spikes(spark, d), alerts(spark, d))


@query("detection_lag_summary", LAGS + """ SELECT substance, count(lag_days) AS n, round(avg(lag_days), 6) AS mean_lag, quantile_cont(lag_days, 0.5) AS median_lag,
  min(lag_days) AS min_lag, max(lag_days) AS max_lag FROM lags GROUP BY 1""")
def detection_lag_summary(spark, d):
    return series.lag_summary(series.detection_lag(official_spikes(spark, d), alerts(spark, d))).withColumn("mean_lag", r6("mean_lag"))


RANKS = f"""WITH {OFFICIAL}, {TRAILING}, {ALERTS}, ranked AS (
  SELECT period AS m, topic, row_number() OVER (PARTITION BY period ORDER BY z_score DESC, topic) AS rank FROM alerts
), asked AS (SELECT substance, period AS spike_period, CAST(period - INTERVAL 2 MONTH AS DATE) AS m FROM spikes
), hits AS (SELECT substance, spike_period, min(rank) AS rank FROM asked JOIN ranked USING (m) WHERE topic IN ('A_F', 'N_O') GROUP BY 1, 2
), ranks AS (
  SELECT a.substance, a.spike_period, a.m AS signal_period, CAST(h.rank AS INTEGER) AS rank, coalesce(1 / h.rank, 0.0) AS reciprocal_rank
  FROM asked a LEFT JOIN hits h USING (substance, spike_period))"""


def ranks(spark, d) -> DataFrame:
    substances = official_spikes(spark, d).select("substance").distinct()
    topics = substances.withColumn("topic", F.explode(F.array(F.lit("A_F"), F.lit("N_O"))))
    return series.reciprocal_ranks(official_spikes(spark, d), alerts(spark, d), substances.withColumn("lead_months", F.lit(2)), topics)


@query("reciprocal_ranks", RANKS + " SELECT substance, spike_period, signal_period, rank, round(reciprocal_rank, 6) AS reciprocal_rank FROM ranks")
def reciprocal_ranks(spark, d):
    return ranks(spark, d).withColumn("reciprocal_rank", r6("reciprocal_rank"))


@query("mrr", RANKS + " SELECT substance, count(*) AS n, round(avg(reciprocal_rank), 6) AS mrr FROM ranks GROUP BY 1")
def mrr(spark, d):
    return series.mean_reciprocal_rank(ranks(spark, d)).withColumn("mrr", r6("mrr"))


def yearly_rates(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("substance")).agg(F.round(F.avg("o_totalprice") / 1000, 4).alias("rate"))


RATES = """rates AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS substance, round(avg(o_totalprice) / 1000, 4) AS rate FROM orders GROUP BY 1, 2
), latest AS (
  SELECT substance, round(avg(rate), 4) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY substance ORDER BY year DESC) AS k FROM rates) WHERE k <= 3 GROUP BY 1)"""


@query("latest3_mean", f"WITH {RATES} SELECT * FROM latest")
def latest3_mean(spark, d):
    return series.latest_mean(yearly_rates(spark, d), key="substance")


@query("normalize_rate", f"""WITH {SOCIAL}, {RATES} SELECT s.period, s.substance, s.post_count,
  round(CASE WHEN l.rate > 0 THEN s.post_count / l.rate * 100 ELSE s.post_count END, 6) AS normalized FROM social s LEFT JOIN latest l USING (substance)""")
def normalize_rate(spark, d):
    rates = series.latest_mean(yearly_rates(spark, d), key="substance")
    out = series.normalize_by_rate(social(spark, d), rates, key="substance", value="post_count")
    return out.select("period", "substance", "post_count", r6("normalized").alias("normalized"))


@query("pivot_rates", f"""WITH {RATES} SELECT year, max(rate) FILTER (substance = '1-URGENT') AS urgent, max(rate) FILTER (substance = '2-HIGH') AS high,
  max(rate) FILTER (substance = '5-LOW') AS low FROM rates GROUP BY 1""")
def pivot_rates(spark, d):
    _, pivoted = readers.denominators(spark, yearly_rates(spark, d), value="rate")
    return pivoted.select("year", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("rates_published", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST({round(sum(v[-3:]) / 3, 4)} AS DOUBLE))" for s, v in config.PREVALENCE.items()) + ") t(substance, rate)")
def rates_published(spark, d):
    return readers.denominators(spark)[0]


@query("union_sources", """SELECT source, count(*) AS n, count(value) AS n_value, count(o_totalprice) AS n_total FROM (
  SELECT 'events' AS source, value, NULL AS o_totalprice FROM events UNION ALL SELECT 'orders', NULL, o_totalprice FROM orders) GROUP BY 1""")
def union_sources(spark, d):
    both = readers.union_sources((table(spark, d, "events"), "events"), (table(spark, d, "orders"), "orders"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"), F.count("o_totalprice").alias("n_total"))


@query("top_states", """SELECT n_name AS state, round(avg(o_totalprice), 6) AS mean_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1998 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def top_states(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.col("n_name").alias("state"), F.col("o_orderpriority").alias("substance"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("deaths"))
    return decide.top_states(rows, substance="1-URGENT", year=1998).withColumn("mean_value", r6("mean_value"))


@query("json_props", """SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1""")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


# --- texts ---------------------------------------------------------------------------------------------------


@query("clean_text", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  'http\S+|www\.\S+', '', 'g'), '@\w+', '', 'g'), '#(\w+)', '\1', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM pages""")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_marks("html", unicode=False).alias("cleaned"))


@query("scrub_pii", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b', '[EMAIL]', 'g'),
  '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '[PHONE]', 'g'), '\b\d{5}(?:-\d{4})?\b', '[ZIP]', 'g') AS scrubbed FROM pages""")
def scrub_pii(spark, d):
    return table(spark, d, "pages").select("page_id", X.scrub("html").alias("scrubbed"))


#: These pages have well-formed elements, no others than these entities, and scripts without a closing tag but in quotes.
VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>', ' ', 'g'), '<style>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
ENTITIES = (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&amp;", "&"))


def unescaped_sql(column: str) -> str:
    for name, character in ENTITIES:
        column = f"replace({column}, '{name}', '{character}')"
    return column


@query("html_text", f"SELECT page_id, trim(regexp_replace({unescaped_sql(VISIBLE)}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    """Visible text of pages; tests hold it against an independent parse."""
    return table(spark, d, "pages").select("page_id", X.html_text("html").alias("text"))


@query("slang_normalize")
def slang_normalize(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(X.normalize_terms("text", LEXICON).cast("binary")).alias("digest"))


def _hits_sql(phrases) -> str:
    return "list_filter([" + ", ".join(f"'{p}'" for p in phrases) + "], lambda p: contains(lower(text), p))"


@query("phrase_hits", "SELECT doc_id, " + ", ".join(f"array_to_string({_hits_sql(v)}, ',') AS {k}" for k, v in SIGNALS.items()) + " FROM documents")
def phrase_hits(spark, d):
    hits = X.phrase_hits("text", SIGNALS)
    rows = table(spark, d, "documents").select("doc_id", hits.alias("h"))
    return rows.select("doc_id", *[F.coalesce(F.array_join(F.col("h")[k], ","), F.lit("")).alias(k) for k in SIGNALS])


def _count_sql(phrases) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), '{p}') AS INTEGER)" for p in phrases) + ")"


LABEL_SQL = f"""SELECT doc_id, CASE WHEN h >= 1 OR (s >= 2 AND rating <= 3) THEN 'high' WHEN s >= 1 OR rating <= 4 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN h >= 1 OR s >= 2 THEN 'high' WHEN s >= 1 THEN 'medium' ELSE 'low' END AS text_only
FROM (SELECT doc_id, {_count_sql(HIGH)} AS h, {_count_sql(DISTRESS)} AS s, nullif(n_chars % 10, 0) AS rating FROM documents)"""


@query("risk_label", LABEL_SQL)
def risk_label(spark, d):
    docs = table(spark, d, "documents").withColumn("rating", F.nullif(F.col("n_chars") % 10, F.lit(0)))
    return docs.select("doc_id", rules.risk_label("text", "rating", high=HIGH, distress=DISTRESS).alias("risk_level"), rules.risk_label("text", high=HIGH, distress=DISTRESS, distress_alone=True).alias("text_only"))


CATEGORIES = {"ring": "metal", "widget": "tool", "red": "colour", "small": "size"}


@query("category_map", "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_name, '{k}') THEN '{v}'" for k, v in CATEGORIES.items()) + " ELSE 'other' END AS category, p_brand LIKE '%1%' OR p_type = 'ECONOMY' AS relevant FROM part")
def category_map(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.first_match(F.col("p_name"), CATEGORIES).alias("category"), rules.is_relevant("p_brand", "p_type", products=["1"], conditions=["economy"]).alias("relevant"))


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_exact(spark, d):
    kept = risk_plan.distinct_posts(table(spark, d, "documents"), text="text", id_col="doc_id")
    return kept.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


#: Runs of what Java's Unicode word class holds.
TOKENS = r"regexp_extract_all(lower(text), '[\pL\p{Mn}\p{Me}\p{Mc}\p{Nd}\p{Pc}]+')"


def near_sql(term: str) -> str:
    """Words within five places of the first occurrence of a term, and what of them counts."""
    stop = ", ".join(f"'{w}'" for w in config.STOPWORDS)
    return f"""list_filter(CASE WHEN list_position(t, {term}) > 0 THEN t[greatest(list_position(t, {term}) - 5, 1):list_position(t, {term}) + 5] ELSE [] END, lambda w: len(w) >= 3 AND w NOT IN ({stop}) AND w <> {term})"""


@query("window_terms", f"SELECT doc_id, array_to_string({near_sql("'thnt'")}, ' ') AS terms FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def window_terms(spark, d):
    """Neighbours of a term; tests hold it against Python's own tokens."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.window_terms("text", "thnt"), " ").alias("terms"))


@query("word_count", r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n, trim(substr(text, 1, 120)) AS snippet
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count("text").cast("long").alias("n"), X.snippet("text").alias("snippet"))


@query("stable_ids", r"""SELECT doc_id, 'post_' || trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') || '_' || substr(sha1(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS post_id FROM documents""")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.stable_id("post", "source", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("post_id"))


def _score_table(spark, d) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    marks = (("thnt", "alpha"), ("onst", "beta"), ("für", "gamma"), ("les", "delta"))
    terms = F.filter(X.bound(F.lower("text"), lambda low: F.array(*[F.when(F.contains(low, F.lit(t)), v) for t, v in marks])), lambda x: x.isNotNull())
    return docs.select(F.col("doc_id").alias("post_id"), "text", terms.alias("substances"), X.phrase_hits("text", SIGNALS).alias("signals"))


SCORES = r"""t AS (
  SELECT doc_id AS post_id, text, contains(lower(text), 'thnt') AS a, contains(lower(text), 'onst') AS b, contains(lower(text), 'für') AS g, contains(lower(text), 'les') AS e,
    regexp_matches(text, '(?i)!!|\?\?') AS marks, regexp_matches(text, '(?i) \| |\$\$\$') AS tables, regexp_matches(text, '(?i)\b(the|of) (and|to)\b') AS pairs,
    regexp_matches(text, '(?i)( oder | pas )') AS neg, regexp_matches(text, '(?i)( une | with )') AS past
  FROM documents
), scores AS (
  SELECT post_id, round(coalesce(greatest(CASE WHEN a THEN 0.9 END, CASE WHEN b THEN 0.55 END, CASE WHEN g THEN 0.3 END, CASE WHEN e THEN 0.4 END)
      * CASE WHEN neg THEN 0.2 WHEN past THEN 0.5 ELSE 1.0 END, 0), 3) AS substance_score,
    greatest(CASE WHEN marks THEN 0.95 ELSE 0 END, CASE WHEN tables THEN 0.8 ELSE 0 END, CASE WHEN pairs THEN 0.4 ELSE 0 END)::DOUBLE AS behavior_score
  FROM t)"""


@query("substance_score", f"WITH {SCORES} SELECT post_id, CAST(substance_score AS DOUBLE) AS substance_score FROM scores")
def substance_score(spark, d):
    score = rules.substance_score("text", "substances", weights=WEIGHTS, negation="( oder | pas )", past="( une | with )")
    return _score_table(spark, d).select("post_id", score.alias("substance_score"))


@query("behavior_score", f"WITH {SCORES} SELECT post_id, behavior_score FROM scores")
def behavior_score(spark, d):
    return _score_table(spark, d).select("post_id", rules.behavior_score("text", GROUPS).alias("behavior_score"))


def rule_scores(spark, d) -> DataFrame:
    rows = _score_table(spark, d).select(
        "post_id", rules.substance_score("text", "substances", weights=WEIGHTS, negation="( oder | pas )", past="( une | with )").alias("substance_score"),
        F.round(0.1 * F.size("signals"), 3).alias("distress_score"), rules.behavior_score("text", GROUPS).alias("behavior_score"),
    )
    return rules.combine(rows).withColumn("routing", rules.route())


RULES = SCORES + ", d AS (SELECT doc_id AS post_id, 0.1 * (" + " + ".join(f"CAST(len({_hits_sql(v)}) > 0 AS INTEGER)" for v in SIGNALS.values()) + """) AS distress_score FROM documents
), c AS (SELECT post_id, substance_score AS s, CAST(distress_score AS DOUBLE) AS x, behavior_score AS b, round(0.3 * CAST(substance_score AS DOUBLE) + 0.35 * CAST(distress_score AS DOUBLE) + 0.35 * behavior_score, 3) AS combined_score
  FROM scores JOIN d USING (post_id)
), rule AS (
  SELECT post_id, combined_score, CASE WHEN b >= 0.9 OR (s >= 0.9 AND x >= 0.7) OR combined_score >= 0.55 THEN 'high' WHEN combined_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE WHEN combined_score >= 0.7 THEN 'rule_based_high' WHEN combined_score <= 0.15 THEN 'rule_based_low' ELSE 'llm' END AS routing FROM c)"""


@query("rule_classify", f"WITH {RULES} SELECT * FROM rule")
def rule_classify(spark, d):
    return rule_scores(spark, d).select("post_id", "combined_score", "risk_level", "routing")


@query("distress_score", "SELECT doc_id AS post_id, CAST(greatest(" + ", ".join(f"CASE WHEN len({_hits_sql(SIGNALS[k])}) > 0 THEN {w} ELSE 0 END" for k, w in (("first", 0.9), ("second", 0.65), ("third", 0.5))) + ", CASE WHEN " + " + ".join(f"CAST(len({_hits_sql(v)}) > 0 AS INTEGER)" for v in SIGNALS.values()) + " >= 3 THEN 0.2 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)pathetic') THEN 0.95 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)clown') THEN 0.7 ELSE 0 END) AS DOUBLE) AS distress_score FROM documents")
def distress_score(spark, d):
    score = rules.distress_score("text", "signals", weights={"first": 0.9, "second": 0.65}, urgency=("pathetic",), escalation=("clown",))
    return _score_table(spark, d).select("post_id", score.alias("distress_score"))


@query("rule_pipeline_domain")
def rule_pipeline_domain(spark, d):
    """The whole rule pipeline with the default vocabulary; tests hold it against a plain version."""
    docs = table(spark, d, "documents").withColumn("text_hash", risk_plan.text_hash("text"))
    done = risk_plan.rule_verdicts(risk_plan.preprocess(docs, text="text", id_col="doc_id", carry=["text_hash"], dedup=False))
    scores = ("substance_score", "distress_score", "behavior_score", "combined_score", "risk_level", "routing")
    return risk_plan.one_a_text(done.select("text_hash", "post_id", *scores), "text_hash")


SPACES = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
WORDS = "[\\pL\\p{Mn}\\p{Me}\\p{Mc}\\p{Nd}\\p{Pc}]+"


def cleaned_sql(column: str) -> str:
    for pattern, new in ((r"http\S+|www\.\S+", ""), (f"@{WORDS}", ""), (f"#({WORDS})", r"\1"), ("<[^>]+>", ""), (SPACES, " ")):
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return f"trim({column})"


def scrubbed_sql(column: str, *, loose: bool = False) -> str:
    """An address may begin with a mark only behind a word character, as a boundary of words stands before it."""
    for pattern, new in ((X.LOOSE_EMAIL if loose else X.EMAIL, "[EMAIL]"), (X.LOOSE_PHONE if loose else X.PHONE, "[PHONE]"), (X.ZIP, "[ZIP]")):
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return column


def terms_sql(column: str, lexicon: dict) -> str:
    """Whole terms between characters that are neither letters nor digits; twice, for neighbours share one."""
    out = f"lower({column})"
    for term in sorted(lexicon, key=lambda t: -len(t)):
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^\\pL\\pN_]){term}($|[^\\pL\\pN_])', '\\1{lexicon[term]}\\2', 'g')"
    return out


SQL["slang_normalize"] = f"SELECT doc_id, md5({terms_sql('text', LEXICON)}) AS digest FROM documents"

PROCESSED = f"""first AS (SELECT min(doc_id) AS post_id, text FROM documents WHERE text IS NOT NULL GROUP BY text
), clean AS (SELECT post_id, {scrubbed_sql(cleaned_sql(unescaped_sql("text")))} AS c FROM first
), processed AS (SELECT post_id, {terms_sql("c", LEXICON)} AS t FROM clean)"""


@query("quality_report", f"""WITH {PROCESSED}, f AS (SELECT t, {" OR ".join(f"regexp_matches(t, '(^|[^{chr(92)}pL{chr(92)}pN_]){v}($|[^{chr(92)}pL{chr(92)}pN_])')" for v in sorted(set(LEXICON.values())))} AS has_term,
    {" OR ".join(f"contains(t, '{p}')" for v in SIGNALS.values() for p in v)} AS has_signal, {" OR ".join(f"regexp_matches(t, '{p}')" for p in (X.EMAIL, X.PHONE, X.ZIP, X.TITLED_NAME))} AS pii FROM processed)
SELECT count(*) AS n_posts, round(avg(CAST(has_term AS INTEGER)), 6) AS substance_rate, round(avg(CAST(has_signal AS INTEGER)), 6) AS distress_rate, count(*) FILTER (pii) AS n_with_pii,
  count(*) FILTER (len(t) = 0) AS n_empty, round(avg(len(t)), 6) AS mean_length FROM f""")
def quality_report(spark, d):
    docs = table(spark, d, "documents").withColumn("text_hash", risk_plan.text_hash("text"))
    return risk_plan.quality_report(risk_plan.preprocess(docs, text="text", id_col="doc_id", lexicon=LEXICON, signals=SIGNALS, carry=["text_hash"], dedup=False), key="text_hash")


@query("ordered_turns", "SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def ordered_turns(spark, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"))


# --- votes ---------------------------------------------------------------------------------------------------


def verdicts(spark, d) -> dict[str, DataFrame]:
    """Four classifiers over documents: rules, thresholds on length, and two partial ones from labels."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    by_length = F.when(F.col("n_chars") >= 4000, "high").when(F.col("n_chars") >= 1500, "medium").otherwise("low")
    truth = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    return {
        "rule": rule_scores(spark, d).select("post_id", "risk_level", F.col("combined_score").alias("confidence")),
        "embedding": docs.where("n_chars > 500").select(F.col("doc_id").alias("post_id"), by_length.alias("risk_level"), F.round(F.least(F.col("n_chars") / 10000, F.lit(1.0)), 3).alias("confidence")),
        "llm": labels.where("quality = 0").select(F.col("doc_id").alias("post_id"), truth.alias("risk_level"), F.lit(None).cast("double").alias("confidence")),
        "finetuned": labels.where("toxic = 1").select(F.col("doc_id").alias("post_id"), truth.alias("risk_level"), F.lit(0.75).alias("confidence")),
        "truth": labels.select(F.col("doc_id").alias("post_id"), truth.alias("truth")),
    }


TRUTH = "CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END"
VERDICTS = RULES + f""", emb AS (
  SELECT doc_id AS post_id, CASE WHEN n_chars >= 4000 THEN 'high' WHEN n_chars >= 1500 THEN 'medium' ELSE 'low' END AS risk_level, round(least(n_chars / 10000, 1.0), 3) AS confidence
  FROM documents WHERE n_chars > 500
), llm AS (SELECT doc_id AS post_id, {TRUTH} AS risk_level FROM labels WHERE quality = 0
), ft AS (SELECT doc_id AS post_id, {TRUTH} AS risk_level, 0.75 AS confidence FROM labels WHERE toxic = 1
), truth AS (SELECT doc_id AS post_id, {TRUTH} AS truth FROM labels
), merged AS (
  SELECT post_id, r.risk_level AS r, r.combined_score AS rc, e.risk_level AS e, e.confidence AS ec, l.risk_level AS l, f.risk_level AS f
  FROM rule r FULL JOIN emb e USING (post_id) LEFT JOIN llm l USING (post_id) LEFT JOIN ft f USING (post_id)
), w AS (
  SELECT *, CASE WHEN r IS NULL THEN 0 WHEN l IS NOT NULL AND f IS NOT NULL THEN 0.2 WHEN l IS NOT NULL THEN 0.25 WHEN f IS NOT NULL THEN 0.3 ELSE 0.35 END AS wr,
    CASE WHEN e IS NULL THEN 0 WHEN l IS NOT NULL AND f IS NOT NULL THEN 0.3 WHEN l IS NOT NULL THEN 0.35 WHEN f IS NOT NULL THEN 0.6 ELSE 0.65 END AS we,
    CASE WHEN l IS NULL THEN 0 ELSE 0.4 END AS wl, CASE WHEN f IS NULL THEN 0 ELSE 0.1 END AS wf
  FROM merged
), v AS (
  SELECT post_id, round(CAST(wr * coalesce(list_position(['low', 'medium', 'high'], r) - 1, 0) + we * coalesce(list_position(['low', 'medium', 'high'], e) - 1, 0)
    + wl * coalesce(list_position(['low', 'medium', 'high'], l) - 1, 0) + wf * coalesce(list_position(['low', 'medium', 'high'], f) - 1, 0) AS DOUBLE) / nullif(wr + we + wl + wf, 0), 6) AS ensemble_score,
    list_filter([r, e, l, f], lambda x: x IS NOT NULL) AS votes,
    (CASE WHEN r IS NULL THEN 0 ELSE rc END + CASE WHEN e IS NULL THEN 0 ELSE ec END + CASE WHEN l IS NULL THEN 0 ELSE 0.5 END + CASE WHEN f IS NULL THEN 0 ELSE 0.75 END) AS conf,
    array_to_string(list_filter([CASE WHEN e IS NOT NULL THEN 'embedding' END, CASE WHEN f IS NOT NULL THEN 'finetuned' END, CASE WHEN l IS NOT NULL THEN 'llm' END, CASE WHEN r IS NOT NULL THEN 'rule' END], lambda x: x IS NOT NULL), '+') AS sources_used
  FROM w
), voted AS (
  SELECT post_id, ensemble_score, CASE WHEN coalesce(ensemble_score, 0) < 0.5 THEN 'low' WHEN ensemble_score < 1.5 THEN 'medium' ELSE 'high' END AS final_risk_level,
    CAST(round(CAST(conf / len(votes) AS DECIMAL(18, 6)), 3) AS DOUBLE) AS ensemble_confidence, len(list_distinct(votes)) = 1 AS method_agreement, sources_used FROM v)"""


def voted(spark, d) -> DataFrame:
    v = verdicts(spark, d)
    return risk_plan.fused_verdicts(v["rule"], v["embedding"], v["llm"], v["finetuned"])


@query("ensemble_vote", f"WITH {VERDICTS} SELECT post_id, ensemble_score, final_risk_level, ensemble_confidence, method_agreement, sources_used FROM voted")
def ensemble_vote(spark, d):
    out = voted(spark, d)
    return out.select("post_id", "ensemble_score", "final_risk_level", "ensemble_confidence", "method_agreement", "sources_used")


@query("compare_methods", f"WITH {VERDICTS} SELECT post_id, r.risk_level AS rule_risk, e.risk_level AS embedding_risk, r.risk_level = e.risk_level AS agree FROM rule r JOIN emb e USING (post_id)")
def compare_methods(spark, d):
    v = verdicts(spark, d)
    return ensemble.compare_methods(v["rule"], v["embedding"])


@query("disagreements", f"WITH {VERDICTS} SELECT r.risk_level AS rule_risk, e.risk_level AS embedding_risk, count(*) AS n FROM rule r JOIN emb e USING (post_id) GROUP BY 1, 2")
def disagreements(spark, d):
    v = verdicts(spark, d)
    return ensemble.compare_methods(v["rule"], v["embedding"]).groupBy("rule_risk", "embedding_risk").agg(F.count(F.lit(1)).alias("n"))


@query("route_counts", f"WITH {RULES} SELECT routing, count(*) AS n FROM rule GROUP BY 1")
def route_counts(spark, d):
    return decide.value_counts(rule_scores(spark, d), "routing")


@query("route_hybrid", f"""WITH {VERDICTS}, h AS (
  SELECT r.post_id, CASE WHEN combined_score >= 0.75 THEN 'rule_high' WHEN combined_score <= 0.1 THEN 'rule_low'
    WHEN combined_score > 0.1 AND combined_score < 0.4 AND coalesce(e.confidence >= 0.2, false) THEN 'embedding' ELSE 'llm' END AS routing
  FROM rule r LEFT JOIN emb e USING (post_id))
SELECT post_id, routing FROM h""")
def route_hybrid(spark, d):
    v = verdicts(spark, d)
    rows = rule_scores(spark, d).drop("routing").join(v["embedding"].select("post_id", "confidence"), "post_id", "left")
    return rules.route_hybrid(rows, cap=None).select("post_id", "routing")


# --- evaluation ----------------------------------------------------------------------------------------------


def judged(spark, d) -> DataFrame:
    return verdicts(spark, d)["truth"].join(voted(spark, d), "post_id", "left")


JUDGED = VERDICTS + ", judged AS (SELECT post_id, truth, final_risk_level, coalesce(final_risk_level, 'low') AS p, ensemble_confidence FROM truth LEFT JOIN voted USING (post_id))"


@query("confusion", f"WITH {JUDGED} SELECT truth, count(*) FILTER (p = 'low') AS low, count(*) FILTER (p = 'medium') AS medium, count(*) FILTER (p = 'high') AS high FROM judged GROUP BY 1")
def confusion(spark, d):
    return metrics.confusion(judged(spark, d), "truth", "final_risk_level")


F1_SQL = JUDGED + """, f AS (
  SELECT label, count(*) FILTER (truth = label) AS n_true, count(*) FILTER (p = label) AS n_predicted, count(*) FILTER (truth = label AND p = label) AS n_both
  FROM judged CROSS JOIN (SELECT unnest(['low', 'medium', 'high']) AS label) GROUP BY 1
), f1 AS (SELECT *, coalesce(n_both / nullif(n_predicted, 0), 0) AS precision, coalesce(n_both / nullif(n_true, 0), 0) AS recall, coalesce(2 * n_both / nullif(n_true + n_predicted, 0), 0) AS f1 FROM f)"""


@query("class_f1", f"WITH {F1_SQL} SELECT label, n_true, n_predicted, n_both, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1")
def class_f1(spark, d):
    out = metrics.class_f1(judged(spark, d), "truth", "final_risk_level")
    return out.select("label", "n_true", "n_predicted", "n_both", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1", f"WITH {F1_SQL} SELECT round(avg(f1), 6) AS macro_f1, (SELECT round(avg(CAST(truth = p AS INTEGER)), 6) FROM judged) AS accuracy FROM f1 WHERE n_true + n_predicted > 0")
def macro_f1(spark, d):
    rows = judged(spark, d)
    score = metrics.macro_f1(metrics.class_f1(rows, "truth", "final_risk_level")).select(r6("macro_f1").alias("macro_f1"))
    return score.crossJoin(metrics.accuracy(rows, "truth", "final_risk_level").select(r6("accuracy").alias("accuracy")))


@query("f1_by_source", f"""WITH {JUDGED}, s AS (SELECT source, truth, p FROM judged JOIN documents ON doc_id = post_id
), f AS (
  SELECT source, label, count(*) FILTER (truth = label) AS n_true, count(*) FILTER (p = label) AS n_predicted, count(*) FILTER (truth = label AND p = label) AS n_both, count(*) AS n
  FROM s CROSS JOIN (SELECT unnest(['low', 'medium', 'high']) AS label) GROUP BY 1, 2)
SELECT source, round(avg(coalesce(2 * n_both / nullif(n_true + n_predicted, 0), 0)), 6) AS macro_f1 FROM f WHERE n >= 5 AND n_true + n_predicted > 0 GROUP BY 1""")
def f1_by_source(spark, d):
    rows = judged(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "source"), "post_id")
    return metrics.macro_f1(metrics.class_f1(rows, "truth", "final_risk_level", keys=["source"], least_rows=5), keys=["source"]).withColumn("macro_f1", r6("macro_f1"))


PROBS = JUDGED + """, probs AS (
  SELECT post_id, truth, label, CAST(truth = label AS INTEGER) AS y,
    round(CASE WHEN p = label THEN coalesce(ensemble_confidence, 0.5) ELSE (1 - coalesce(ensemble_confidence, 0.5)) / 2 END, 6) AS q
  FROM judged CROSS JOIN (SELECT unnest(['low', 'medium', 'high']) AS label))"""


def probabilities(spark, d) -> DataFrame:
    rows = judged(spark, d).withColumn("c", F.col("ensemble_confidence"))
    spread = metrics.spread_probabilities("final_risk_level", "c")
    rows = rows.withColumns({f"p_{k}": F.round(v, 6) for k, v in spread.items()})
    return metrics.one_vs_rest(rows, "truth", {k: f"p_{k}" for k in config.RISKS})


@query("auc_ovr", f"""WITH {PROBS}, ranked AS (SELECT label, y, rank() OVER w + (count(*) OVER (PARTITION BY label, q) - 1) / 2.0 AS k FROM probs WINDOW w AS (PARTITION BY label ORDER BY q))
SELECT label, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, round(CAST(sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2 AS DOUBLE) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc FROM ranked GROUP BY 1""")
def auc_ovr(spark, d):
    return metrics.roc_auc(probabilities(spark, d), "y", "p", keys=["label"]).withColumn("auc", r6("auc"))


@query("roc_points", f"""WITH {PROBS}, s AS (SELECT label, q AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM probs GROUP BY 1, 2)
SELECT label, threshold, round(sum(pos) OVER w / nullif(sum(pos) OVER a, 0), 6) AS tpr, round(sum(neg) OVER w / nullif(sum(neg) OVER a, 0), 6) AS fpr FROM s
WINDOW w AS (PARTITION BY label ORDER BY threshold DESC), a AS (PARTITION BY label)""")
def roc_points(spark, d):
    out = metrics.roc_points(probabilities(spark, d), "y", "p", keys=["label"])
    return out.select("label", "threshold", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query("method_summary", f"""WITH {VERDICTS}, m AS (
  SELECT 'rule' AS method, post_id, risk_level AS p FROM rule UNION ALL SELECT 'embedding', post_id, risk_level FROM emb UNION ALL SELECT 'ensemble', post_id, final_risk_level FROM voted)
SELECT method, count(*) AS n, round(100 * avg(CAST(p = 'high' AS INTEGER)), 6) AS pct_high, round(100 * avg(CAST(p = 'medium' AS INTEGER)), 6) AS pct_medium,
  round(100 * avg(CAST(p = 'low' AS INTEGER)), 6) AS pct_low, round(avg(CAST(p = truth AS INTEGER)), 6) AS accuracy FROM m LEFT JOIN truth USING (post_id) GROUP BY 1""")
def method_summary(spark, d):
    rows = voted(spark, d).join(verdicts(spark, d)["truth"], "post_id", "left")
    out = metrics.method_summary(rows, {"rule": "rule_risk_level", "embedding": "embedding_risk_level", "ensemble": "final_risk_level"}, "truth")
    return out.select("method", "n", *[r6(c).alias(c) for c in ("pct_high", "pct_medium", "pct_low", "accuracy")])


@query("stratified_sample", f"""WITH t AS (SELECT doc_id AS post_id, {TRUTH} AS truth FROM labels), s AS (
  SELECT truth, count(*) AS n FROM t GROUP BY 1), k AS (
  SELECT t.*, row_number() OVER (PARTITION BY truth ORDER BY md5('test:' || post_id), post_id) AS k FROM t)
SELECT post_id, truth FROM k JOIN s USING (truth) WHERE k <= round(100 * n / (SELECT sum(n) FROM s))""")
def stratified_sample(spark, d):
    return metrics.stratified_sample(verdicts(spark, d)["truth"], label="truth", key="post_id", n=100)


@query("bigram_perplexity", """WITH tok AS (
  SELECT item_id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM benchmark
), tr AS (SELECT unnest(list_prepend('<s>', t[:-2])) AS prev, unnest(t) AS w FROM tok WHERE len(t) > 0
), te AS (
  SELECT conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM conversations
), ask AS (SELECT id, unnest(list_prepend('<s>', t[:-2])) AS prev, unnest(t) AS w FROM te WHERE len(t) > 0
), two AS (SELECT prev, w, count(*) AS c2 FROM tr GROUP BY 1, 2
), one AS (SELECT w AS prev, count(*) AS c1 FROM tr GROUP BY 1 UNION ALL SELECT '<s>', count(*) FROM tr WHERE prev = '<s>'
), v AS (SELECT count(DISTINCT w) AS v FROM tr)
SELECT id, count(*) AS n, round(exp(-avg(ln((coalesce(c2, 0) + 1) / (coalesce(c1, 0) + v)))), 6) AS perplexity
FROM ask LEFT JOIN two USING (prev, w) LEFT JOIN one USING (prev), v GROUP BY 1""")
def bigram_perplexity(spark, d):
    train = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    test = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return metrics.perplexity(train, test, id_col="id", text="text").withColumn("perplexity", r6("perplexity"))


@query("rouge_l")
def rouge_l(spark, d):
    """Each conversation's last turn against its first; tests hold it against a quadratic table."""
    from tidemark.functions.stats import rouge_l as score

    ends = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    return ends.select("conv_id", r6(score("b", "a")).alias("rouge_l"))


# --- vectors -------------------------------------------------------------------------------------------------

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def seeds(spark, d) -> DataFrame:
    """The first 20 vectors of each risk by vec_id, descending."""
    bank = knn.seed_bank(vectors(spark, d), label="risk", order="vec_id", tie="vec_id", n=20)
    return bank.select(F.col("vec_id").alias("seed_id"), F.col("risk").alias("label"), "embedding")


SEEDS = """seeds AS (SELECT vec_id AS seed_id, risk AS label, e AS se, len AS sl FROM (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY vec_id DESC) AS k FROM sized) WHERE k <= 20
), sims AS (SELECT vec_id, seed_id, seeds.label, round(""" + DOT.format(a="e", b="se") + """ / (len * sl), 9) AS similarity FROM sized, seeds)"""


@query("seed_bank_topn", f"WITH {VECTORS}, {SEEDS} SELECT seed_id, label FROM seeds")
def seed_bank_topn(spark, d):
    return seeds(spark, d).select("seed_id", "label")


@query("knn_global", f"WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, seed_id) AS rank FROM sims) SELECT vec_id, seed_id, label, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def knn_global(spark, d):
    return knn.neighbours(vectors(spark, d), seeds(spark, d), id_col="vec_id", vector="embedding", k=10).withColumn("similarity", r6("similarity"))


@query("knn_per_class", f"WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY similarity DESC, seed_id) AS rank FROM sims) SELECT vec_id, label, round(avg(similarity), 6) AS score FROM k WHERE rank <= 10 GROUP BY 1, 2")
def knn_per_class(spark, d):
    hits = knn.neighbours(vectors(spark, d), seeds(spark, d), id_col="vec_id", vector="embedding", k=10, per_label=True)
    return hits.groupBy("vec_id", "label").agg(r6(F.avg("similarity")).alias("score"))


@query("embedding_classify", f"""WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY similarity DESC, seed_id) AS rank FROM sims
), m AS (SELECT vec_id, label, greatest(avg(similarity), 0) AS s FROM k WHERE rank <= 10 GROUP BY 1, 2
), p AS (SELECT vec_id, label, s / sum(s) OVER (PARTITION BY vec_id) AS p FROM m)
SELECT vec_id, round(max(p) FILTER (label = 'high'), 6) AS prob_high, round(max(p) FILTER (label = 'medium'), 6) AS prob_medium, round(max(p) FILTER (label = 'low'), 6) AS prob_low FROM p GROUP BY 1""")
def embedding_classify(spark, d):
    out = knn.classify_by_neighbours(vectors(spark, d), seeds(spark, d), id_col="vec_id", vector="embedding")
    return out.select("vec_id", *[r6(f"prob_{c}").alias(f"prob_{c}") for c in ("high", "medium", "low")])


@query("embedding_classify_global", f"""WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, seed_id) AS rank FROM sims
), m AS (SELECT vec_id, c, greatest(coalesce(avg(similarity) FILTER (label = c), 0), 0) AS s FROM k, (SELECT unnest(['high', 'medium', 'low']) AS c) WHERE rank <= 10 GROUP BY 1, 2
), p AS (SELECT vec_id, c, round(CASE WHEN sum(s) OVER (PARTITION BY vec_id) > 0 THEN s / sum(s) OVER (PARTITION BY vec_id) ELSE 1 / 3 END, 9) AS p FROM m
), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, list_position(['high', 'medium', 'low'], c)) AS k FROM p
), r AS (SELECT vec_id, max(c) FILTER (k = 1) AS risk_level, round(max(p) FILTER (k = 1) - max(p) FILTER (k = 2), 9) AS confidence FROM o GROUP BY 1)
SELECT vec_id, risk_level, round(confidence, 6) AS confidence, confidence < 0.15 AS needs_review FROM r""")
def embedding_classify_global(spark, d):
    out = knn.classify_by_neighbours(vectors(spark, d), seeds(spark, d), id_col="vec_id", vector="embedding", mode="global")
    return out.select("vec_id", "risk_level", r6("confidence").alias("confidence"), "needs_review")


QUERY = [1.0 if k % 3 == 0 else -0.5 for k in range(64)]


@query("retrieve_topk", f"WITH {VECTORS} SELECT vec_id, round(" + DOT.format(a="e", b=f"CAST({QUERY} AS DOUBLE[])") + f" / (len * {sum(x * x for x in QUERY) ** 0.5!r}), 6) AS similarity FROM sized WHERE risk = 'high' ORDER BY 2 DESC, 1 LIMIT 5")
def retrieve_topk(spark, d):
    return knn.retrieve(QUERY, vectors(spark, d), id_col="vec_id", vector="embedding", where="risk = 'high'").select("vec_id", r6("similarity").alias("similarity"))


@query("centroids", f"WITH {VECTORS}, x AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS k FROM vectors) SELECT label, CAST(k AS INTEGER) AS place, round(avg(x), 6) AS mean, count(*) AS n FROM x GROUP BY 1, 2")
def centroids(spark, d):
    middle = V.centroids(vectors(spark, d), ["label"], "embedding")
    return middle.select("label", "n", F.posexplode("centroid").alias("place", "mean")).withColumn("mean", r6("mean"))


WINDOWS = VECTORS + """, u AS (SELECT CAST(date_trunc('week', t) AS DATE) AS period, risk, unnest(e) AS x, unnest(range(len(e))) AS k FROM vectors
), c AS (SELECT period, k, avg(x) AS x, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 10
), cc AS (SELECT period, max(n) AS n, list(x ORDER BY k) AS c FROM c GROUP BY 1
), pair AS (SELECT period, n, c, lag(c) OVER (ORDER BY period) AS p FROM cc
), drifts AS (SELECT period, n, round(1 - """ + DOT.format(a="c", b="p") + """ / nullif(sqrt(list_sum(list_transform(c, lambda x: x * x))) * sqrt(list_sum(list_transform(p, lambda x: x * x))), 0), 4) AS drift_score FROM pair)"""


def drift_windows(spark, d) -> DataFrame:
    return narrative.drift(narrative.window_centroids(vectors(spark, d), time="t", vector="embedding", risk="risk"))


@query("drift", f"WITH {WINDOWS} SELECT period, n, drift_score, round(sum(coalesce(drift_score, 0)) OVER (ORDER BY period), 4) AS cumulative_drift FROM drifts")
def drift(spark, d):
    return drift_windows(spark, d).select("period", "n", "drift_score", "cumulative_drift")


DIRECTIONS = WINDOWS + """, hu AS (SELECT period, k, avg(x) AS x FROM u WHERE risk = 'high' GROUP BY 1, 2 HAVING count(*) >= 3
), hc AS (SELECT period, list(x ORDER BY k) AS h FROM hu GROUP BY 1
), seen AS (SELECT d.*, lag(h) OVER (ORDER BY period) AS ph FROM drifts d LEFT JOIN hc USING (period)
), sided AS (SELECT *, list_cosine_similarity(c, ph) AS now_, list_cosine_similarity(p, ph) AS then_ FROM seen)"""


@query("drift_direction", f"""WITH {DIRECTIONS.replace("SELECT period, n, round(1 -", "SELECT period, n, c, p, round(1 -")}
SELECT period, CASE WHEN p IS NULL THEN NULL WHEN ph IS NULL THEN 'unknown' WHEN now_ > then_ THEN 'toward_risk' ELSE 'away_from_risk' END AS drift_direction,
  round(CASE WHEN stddev_samp(drift_score) OVER () > 0 THEN (drift_score - avg(drift_score) OVER ()) / stddev_samp(drift_score) OVER () ELSE 0 END, 6) AS z,
  coalesce((drift_score - avg(drift_score) OVER ()) / nullif(stddev_samp(drift_score) OVER (), 0) > 2, false) AS is_drift_event FROM sided""")
def drift_direction(spark, d):
    return drift_windows(spark, d).select("period", "drift_direction", r6("z").alias("z"), "is_drift_event")


ANCHORS = {"relapse": [1.0 if k < 20 else 0.0 for k in range(64)], "recovery": [1.0 if k % 2 else -1.0 for k in range(64)]}


def topic_table(spark, d) -> DataFrame:
    return narrative.topic_prevalence(vectors(spark, d), ANCHORS, time="t", vector="embedding", share_above=0.1)


TOPIC_SQL = VECTORS + ", tp AS (SELECT CAST(date_trunc('week', t) AS DATE) AS period, " + ", ".join("round(" + DOT.format(a="e", b=f"CAST({v} AS DOUBLE[])") + f" / (len * {sum(x * x for x in v) ** 0.5!r}), 9) AS {k}" for k, v in ANCHORS.items()) + """ FROM sized
), topics AS (SELECT period, count(*) AS post_count, """ + ", ".join(f"round(quantile_cont({k}, 0.75), 6) AS {k}_score, round(avg(CAST({k} > 0.1 AS INTEGER)), 6) AS {k}_pct" for k in ANCHORS) + " FROM tp GROUP BY 1)"


@query("topic_prevalence", f"WITH {TOPIC_SQL} SELECT * FROM topics")
def topic_prevalence(spark, d):
    out = topic_table(spark, d)
    return out.select("period", "post_count", *[r6(c).alias(c) for c in out.columns if c.endswith(("_score", "_pct"))])


@query("melt_topics", f"WITH {TOPIC_SQL} SELECT period, 'relapse' AS topic, relapse_score AS score FROM topics UNION ALL SELECT period, 'recovery', recovery_score FROM topics")
def melt_topics(spark, d):
    return narrative.melt_topics(topic_table(spark, d)).withColumn("score", r6("score"))


@query("window_composition", f"""WITH {POSTS}, w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, * FROM posts
), s AS (SELECT period, substance, count(*) AS n, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, substance) AS k FROM w GROUP BY 1, 2
), top AS (SELECT period, string_agg(substance || '=' || n, ',' ORDER BY substance) AS substances FROM s WHERE k <= 3 GROUP BY 1)
SELECT period, count(*) AS post_count, round(avg(CAST(risk = 'high' AS INTEGER)), 6) AS pct_high, round(avg(CAST(risk = 'medium' AS INTEGER)), 6) AS pct_medium,
  round(avg(CAST(risk = 'low' AS INTEGER)), 6) AS pct_low, any_value(substances) AS substances FROM w JOIN top USING (period) GROUP BY 1 HAVING count(*) >= 10""")
def window_composition(spark, d):
    rows = posts(spark, d).withColumn("s", F.array("substance"))
    out = narrative.window_composition(rows, time="ts", risk="risk", substances="s")
    text = F.array_join(F.transform(F.map_entries("substances"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("period", "post_count", *[r6(c).alias(c) for c in ("pct_high", "pct_medium", "pct_low")], text.alias("substances"))


@query("silhouette", f"""WITH {VECTORS}, u AS (SELECT vec_id, label, list_transform(e, lambda x: x / len) AS u FROM sized
), x AS (SELECT label, unnest(u) AS x, unnest(range(len(u))) AS k FROM u), s AS (SELECT label, k, sum(x) AS s, count(*) AS n FROM x GROUP BY 1, 2
), sums AS (SELECT label AS c, max(n) AS n, list(s ORDER BY k) AS s FROM s GROUP BY 1
), far AS (SELECT vec_id, label, c, n, {DOT.format(a="u", b="s")} AS d FROM u, sums
), ab AS (SELECT vec_id, label, max(CASE WHEN c = label THEN n END) AS own, max(CASE WHEN c = label THEN (n - d) / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> label THEN 1 - d / n END) AS b FROM far GROUP BY 1, 2)
SELECT vec_id, label, round(CASE WHEN own = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END, 6) AS silhouette FROM ab""")
def silhouette(spark, d):
    return metrics.silhouette(vectors(spark, d), id_col="vec_id", vector="embedding", cluster="label").withColumn("silhouette", r6("silhouette"))


@query("ndcg", f"""WITH {VECTORS}, sc AS (SELECT round({DOT.format(a="e", b=f"CAST({QUERY} AS DOUBLE[])")}, 1) AS s, list_position(['low', 'medium', 'high'], risk) - 1 AS rel FROM sized
), a AS (SELECT avg(rel) OVER (PARTITION BY s) AS g, row_number() OVER (ORDER BY s DESC) AS r FROM sc
), i AS (SELECT rel AS g, row_number() OVER (ORDER BY rel DESC) AS r FROM sc
), ks AS (SELECT unnest([50, 100, 500]) AS k)
SELECT k, round((SELECT sum(g / log2(r + 1)) FROM a WHERE r <= k) / (SELECT sum(g / log2(r + 1)) FROM i WHERE r <= k), 6) AS ndcg FROM ks""")
def ndcg(spark, d):
    gain = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    rows = vectors(spark, d).select(F.round(V.dot("embedding", F.array(*map(F.lit, QUERY))), 1).alias("s"), gain.alias("rel"))
    return metrics.ndcg(rows, score="s", relevance="rel").withColumn("ndcg", r6("ndcg"))


@query("cluster_label", f"""WITH {VECTORS}, x AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS k FROM vectors), m AS (SELECT label, k, avg(x) AS x FROM x GROUP BY 1, 2
), c AS (SELECT label, list(x ORDER BY k) AS c FROM m GROUP BY 1
), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round({DOT.format(a="e", b="c")} / (len * sqrt(list_sum(list_transform(c, lambda x: x * x)))), 9) DESC, vec_id) AS k FROM sized JOIN c USING (label))
, counts AS (SELECT label, risk, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, risk) AS k, sum(count(*)) OVER (PARTITION BY label) AS n FROM vectors GROUP BY 1, 2
), top AS (SELECT label, risk, CAST(n AS BIGINT) AS n FROM counts WHERE k = 1)
SELECT label, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY r.k) AS examples, any_value(top.risk) AS risk, 's' || any_value(top.risk) AS substance, any_value(n) AS n FROM r JOIN top USING (label) WHERE r.k <= 5 GROUP BY 1""")
def cluster_label(spark, d):
    rows = vectors(spark, d).withColumn("substance", F.concat(F.lit("s"), "risk"))
    out = clusters.label_clusters(rows, id_col="vec_id", vector="embedding", cluster="label", substance="substance", risk="risk")
    return out.select("label", F.array_join("examples", ",").alias("examples"), "risk", "substance", "n")


@query("kmeans")
def kmeans(spark, d):
    return clusters.cluster_posts(vectors(spark, d), vector="embedding").select("vec_id", "cluster")


@query("pca")
def pca(spark, d):
    middle = V.centroids(vectors(spark, d), ["label"], "embedding")
    return narrative.trajectory_2d(middle).select("label", r6("x").alias("x"), r6("y").alias("y"))


@query("logreg")
def logreg(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "text")
    truth = verdicts(spark, d)["truth"].withColumnRenamed("truth", "risk_level")
    return clusters.run_inference(clusters.train_classifier(docs.join(truth, "post_id"), text="text", label="risk_level"), docs, id_col="post_id")


# --- decisions -----------------------------------------------------------------------------------------------


@query("warning_report", f"WITH {ALERTS} SELECT period, topic, z_score, pct_increase, alert_level, 'no significant lead' AS lead_lag FROM alerts")
def warning_report(spark, d):
    return narrative.warning_report(alerts(spark, d).drop("alert_level"))


@query("recommendations", f"""WITH {ALERTS}, r AS (SELECT *, CAST(pct_increase AS VARCHAR) AS pct FROM alerts)
SELECT period, topic, unnest(['IMMEDIATE', 'IMMEDIATE']) AS severity, unnest(['Deploy naloxone in top-3 states by death rate (Unknown)', 'Activate early warning protocol 3 months before projected spike']) AS recommendation FROM r WHERE alert_level = 'critical'
UNION ALL SELECT period, topic, 'MONITOR', 'Monitor local community forums and alert local health officials' FROM r WHERE alert_level = 'elevated'
UNION ALL SELECT period, topic, 'INFORMATIONAL', 'Track topic trajectory in dashboard' FROM r WHERE alert_level = 'watch'""")
def recommendations(spark, d):
    return decide.recommendations(narrative.warning_report(alerts(spark, d).drop("alert_level"))).drop("rationale")


@query("alert_kpis", f"WITH {ALERTS} SELECT alert_level, count(*) AS n FROM alerts GROUP BY 1")
def alert_kpis(spark, d):
    return decide.alert_kpis(alerts(spark, d))


@query("most_flagged_topic", f"WITH {ALERTS} SELECT topic, count(*) AS n FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def most_flagged_topic(spark, d):
    return decide.most_flagged_topic(alerts(spark, d))


@query("window_kpis", f"WITH {WINDOWS} SELECT count(*) AS n_windows, max(drift_score) AS max_drift FROM drifts")
def window_kpis(spark, d):
    return decide.window_kpis(drift_windows(spark, d).withColumn("pct_high", F.lit(0.0))).select("n_windows", "max_drift")


@query("monthly_high_spikes", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS start, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1
), z AS (SELECT *, (n - avg(n) OVER ()) / stddev_samp(n) OVER () AS z FROM m)
SELECT start, CAST(start + INTERVAL 1 MONTH AS DATE) AS "end", n, round(z, 6) AS z FROM z WHERE z > 1.5 ORDER BY n DESC, start LIMIT 8""")
def monthly_high_spikes(spark, d):
    rows = table(spark, d, "orders").select("o_orderdate", F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("risk"))
    return narrative.monthly_high_spikes(rows, time="o_orderdate", risk="risk").select("start", "end", "n", r6("z").alias("z"))


@query("posts_in_windows", f"""WITH {OFFICIAL}, {TRAILING}, w AS (SELECT DISTINCT period AS start, CAST(period + INTERVAL 1 MONTH AS DATE) AS e FROM spikes WHERE substance = '1-URGENT')
SELECT start, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN w ON o_orderdate >= start AND o_orderdate < e GROUP BY 1 HAVING count(*) >= 5""")
def posts_in_windows(spark, d):
    windows = official_spikes(spark, d).where("substance = '1-URGENT'").select(F.col("period").alias("start"), F.add_months("period", 1).alias("end"))
    hit = decide.posts_in_windows(table(spark, d, "orders"), windows, time="o_orderdate")
    return hit.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("evidence_spans", f"""WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, seed_id) AS rank FROM sims), c AS (SELECT * FROM k WHERE rank <= 10
), s AS (SELECT *, CASE WHEN max(similarity) OVER w > min(similarity) OVER w THEN (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) ELSE 1 END AS sc FROM c WINDOW w AS (PARTITION BY vec_id)
), v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS k FROM c GROUP BY 1, 2)
SELECT s.vec_id, count(*) AS n, round(avg(sc) FILTER (rank <= 5), 6) AS confidence, any_value(v.label) AS inferred_risk FROM s JOIN v ON v.vec_id = s.vec_id AND v.k = 1 GROUP BY 1""")
def evidence_spans(spark, d):
    hits = knn.neighbours(vectors(spark, d), seeds(spark, d), id_col="vec_id", vector="embedding", k=10).withColumn("text", F.concat(F.lit("seed "), F.col("seed_id").cast("string")))
    out = decide.evidence_records(hits, keys=["vec_id"], id_col="seed_id", text="text", risk="label")
    return out.select("vec_id", "n", "confidence", "inferred_risk")


@query("value_counts", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, d):
    return decide.value_counts(table(spark, d, "documents"), "source")


@query("stream_weekly", f"WITH {POSTS} SELECT CAST(date_trunc('week', ts) AS DATE) AS period, substance, count(*) AS post_count FROM posts GROUP BY 1, 2")
def stream_weekly(spark, d):
    """The streaming plan over a bounded input."""
    from tidemark.streaming.binning import bin_stream

    return bin_stream(posts(spark, d), time="ts", keys=["substance"])


@query("describe_scores", f"""WITH {RULES} SELECT count(combined_score) AS n, round(avg(combined_score), 6) AS mean, round(stddev_samp(combined_score), 6) AS std, min(combined_score) AS min,
  round(quantile_cont(combined_score, 0.25), 6) AS q25, round(quantile_cont(combined_score, 0.5), 6) AS q50, round(quantile_cont(combined_score, 0.75), 6) AS q75, max(combined_score) AS max FROM rule""")
def describe_scores(spark, d):
    out = decide.describe(rule_scores(spark, d), "combined_score")
    return out.select("n", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("month_context", f"""WITH {OFFICIAL}, m AS (SELECT period, max_by(substance, (deaths, substance)) AS top_substance, max(deaths) AS top_deaths FROM official GROUP BY 1
), w AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS start FROM lineitem) SELECT start, top_substance, top_deaths FROM w LEFT JOIN m ON period = start""")
def month_context(spark, d):
    windows = table(spark, d, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("date").alias("start")).distinct()
    return decide.month_context(official(spark, d), windows)


@query("best_label_score", f"""WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY similarity DESC, seed_id) AS rank FROM sims
), m AS (SELECT vec_id, label, round(avg(similarity), 9) AS score FROM k WHERE rank <= 5 GROUP BY 1, 2) SELECT vec_id, round(max(score), 6) AS score FROM m GROUP BY 1""")
def best_label_score(spark, d):
    out = knn.best_label_score(vectors(spark, d), seeds(spark, d), id_col="vec_id", vector="embedding")
    return out.select("vec_id", r6("score").alias("score"))


@query("cluster_ndcg", f"""WITH {VECTORS}, sc AS (SELECT label, round({DOT.format(a="e", b=f"CAST({QUERY} AS DOUBLE[])")}, 1) AS s, list_position(['low', 'medium', 'high'], risk) - 1 AS rel FROM sized
), c AS (SELECT label, round(avg(s), 6) AS s, round(avg(rel), 6) AS rel FROM sc GROUP BY 1
), a AS (SELECT avg(rel) OVER (PARTITION BY s) AS g, row_number() OVER (ORDER BY s DESC) AS r FROM c), i AS (SELECT rel AS g, row_number() OVER (ORDER BY rel DESC) AS r FROM c)
SELECT 50 AS k, round((SELECT sum(g / log2(r + 1)) FROM a) / (SELECT sum(g / log2(r + 1)) FROM i), 6) AS ndcg""")
def cluster_ndcg(spark, d):
    gain = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    rows = vectors(spark, d).select("label", F.round(V.dot("embedding", F.array(*map(F.lit, QUERY))), 1).alias("s"), gain.alias("rel"))
    means = rows.groupBy("label").agg(r6(F.avg("s")).alias("s"), r6(F.avg("rel")).alias("rel"))
    return metrics.ndcg(means, score="s", relevance="rel", ks=(50,)).withColumn("ndcg", r6("ndcg"))


@query("earliest_median_lag", LAGS + ", s AS (SELECT substance, quantile_cont(lag_days, 0.5) AS median_lag FROM lags GROUP BY 1) SELECT substance, median_lag FROM s WHERE median_lag < 0 ORDER BY 2, 1 LIMIT 1")
def earliest_median_lag(spark, d):
    return decide.earliest_median_lag(series.lag_summary(series.detection_lag(official_spikes(spark, d), alerts(spark, d))))


@query("flat_correlations", P_VALUES + """, best AS (SELECT substance, shift_lag AS best_lag FROM ps WHERE p < 0.05 QUALIFY row_number() OVER (PARTITION BY substance ORDER BY r DESC, shift_lag DESC) = 1)
SELECT substance, shift_lag, lead_months, n, round(r, 6) AS r, round(p, 6) AS p, coalesce(p < 0.05, false) AS significant, best_lag FROM ps LEFT JOIN best USING (substance)""")
def flat_correlations(spark, d):
    out = decide.flat_correlations(correlations(spark, d))
    best = decide.best_significant_lag(out).withColumnRenamed("shift_lag", "best_lag").drop("r")
    return out.withColumns({"r": r6("r"), "p": r6("p")}).join(best, "substance", "left")


EVIDENCE = f"""{WINDOWS}, z AS (SELECT *, coalesce((drift_score - avg(drift_score) OVER ()) / nullif(stddev_samp(drift_score) OVER (), 0) > 2, false) AS event FROM drifts
), w AS (SELECT period AS start FROM z WHERE event OR NOT (SELECT bool_or(event) FROM z) ORDER BY drift_score DESC NULLS LAST, period LIMIT 12
), inside AS (SELECT start, vec_id, risk, round({DOT.format(a="e", b=f"CAST({QUERY} AS DOUBLE[])")} / (len * {sum(x * x for x in QUERY) ** 0.5!r}), 9) AS similarity FROM sized JOIN w ON t >= start AND t < start + 7
), ranked AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY similarity DESC, vec_id) AS rank FROM inside QUALIFY count(*) OVER (PARTITION BY start) >= 5
), kept AS (SELECT *, (similarity - min(similarity) OVER g) / nullif(max(similarity) OVER g - min(similarity) OVER g, 0) AS sc FROM ranked WHERE rank <= 10 WINDOW g AS (PARTITION BY start)
), votes AS (SELECT start, risk, row_number() OVER (PARTITION BY start ORDER BY count(*) DESC, risk) AS k FROM kept GROUP BY 1, 2)"""


@query("spike_evidence", f"""WITH {EVIDENCE}
SELECT kept.start, count(*) AS n, round(avg(coalesce(sc, 1)) FILTER (rank <= 5), 6) AS confidence, string_agg('post ' || vec_id, ',' ORDER BY rank) FILTER (rank <= 5) AS evidence, any_value(votes.risk) AS inferred_risk
FROM kept JOIN votes ON votes.start = kept.start AND votes.k = 1 GROUP BY 1 HAVING count(*) >= 3""")
def spike_evidence(spark, d):
    """Evidence for the weeks of most drift; tests also hold the ranks against brute force."""
    from tidemark.plans.evidence import spike_evidence as run

    rows = vectors(spark, d).withColumns({"text": F.concat(F.lit("post "), F.col("vec_id").cast("string")), "substance": F.concat(F.lit("s"), F.col("label").cast("string"))})
    windows = narrative.spike_periods(drift_windows(spark, d))
    queries = windows.select("start", F.array(*map(F.lit, QUERY)).alias("query_vector"))
    return run(rows, windows, queries, time="t", id_col="vec_id", vector="embedding", text="text", substance="substance", risk="risk")["evidence"].withColumn("evidence", F.array_join("evidence", ","))


from tidemark.plans import catalog_rest, catalog_sources  # noqa: E402, F401  (they register their queries)
