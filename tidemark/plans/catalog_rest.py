"""Queries over the functions that the other catalogues do not show alone: cleaning, labels, reports, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X
from tidemark.operators import decide, knn, metrics, narrative, rules, series
from tidemark.plans import catalog
from tidemark.plans.catalog import (
    ALERTS, EVIDENCE, LEXICON, POSTS, QUERY, SEEDS, TOKENS, VECTORS, VERDICTS, alerts, cleaned_sql, drift_windows, near_sql, posts, query, r6, rule_scores, scrubbed_sql, seeds, table,
    unescaped_sql, vectors, verdicts,
)
from tidemark.plans.catalog_sources import first_of, how_many, label_sql, pick, pick_sql, s


def values(spark, rows, names: str):
    return spark.createDataFrame(rows, names)


# --- texts ---------------------------------------------------------------------------------------------------


@query("basic_clean", f"SELECT page_id, md5({cleaned_sql(unescaped_sql('html'))}) AS digest FROM pages")
def basic_clean(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.clean("html").cast("binary")).alias("digest"))


@query("unescape_html", f"SELECT page_id, md5({unescaped_sql('html')}) AS digest FROM pages")
def unescape_html(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.unescape_html("html").cast("binary")).alias("digest"))


CONTACT = "' mail a.b+c@x-y.org, call 555-123-4567 or (555) 123 4567, zip 12345-6789, Mr. Smith '"


@query("scrub_loose", f"SELECT doc_id, {scrubbed_sql(CONTACT + ' || doc_id', loose=True)} AS loose, {scrubbed_sql(CONTACT + ' || doc_id')} AS strict FROM documents")
def scrub_loose(spark, d):
    text = F.concat(F.lit(CONTACT.strip("'")), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", X.scrub(text, loose=True).alias("loose"), X.scrub(text).alias("strict"))


@query("has_pii", "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in (X.EMAIL, X.PHONE, X.ZIP, X.TITLED_NAME)) + " AS found FROM documents")
def has_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_pii("text").alias("found"))


@query("slang_and_back", "SELECT doc_id, true AS same, doc_id || ' took alpha, then beta; gamma and delta' AS text FROM documents")
def slang_and_back(spark, d):
    """Canonical terms to slang, by the hash of the id, and back to where they came from."""
    text = F.concat(F.col("doc_id").cast("string"), F.lit(" took alpha, then beta; gamma and delta"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("before"), X.to_slang(text, "doc_id", LEXICON).alias("slang"))
    return rows.select("doc_id", (F.col("slang") != F.col("before")).alias("same"), X.normalize_terms("slang", LEXICON).alias("text"))


REPLIES = ('```json\n{"risk_level": "high", "confidence": 0.5}\n```', '{"risk_level": "low"}', "``` \n{\"risk_level\": \"medium\"}```", "no json")


@query("json_body", "SELECT * FROM (VALUES (0, 'high'), (1, 'low'), (2, 'medium'), (3, NULL)) t(k, risk_level)")
def json_body(spark, d):
    rows = values(spark, list(enumerate(REPLIES)), "k int, reply string")
    return rows.select("k", F.from_json(X.json_body("reply"), "risk_level string")["risk_level"].alias("risk_level"))


@query("title_case", "SELECT * FROM (VALUES " + ", ".join(f"('{t}_score', '{t.replace('_', ' ').title()}')" for t in config.TOPICS) + ") t(name, title)")
def title_case(spark, d):
    return values(spark, [(f"{t}_score",) for t in config.TOPICS], "name string").select("name", X.title_case("name").alias("title"))


@query("report_years", r"""SELECT doc_id, CAST(nullif(regexp_extract(t, '(?i)Year:\s*(\d{4})', 1), '') AS INTEGER) AS labelled, CAST(nullif(regexp_extract(t, '\b(19[89]\d|20[012]\d)\b', 1), '') AS INTEGER) AS first
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'in 1975 and 1999, YEAR:  ' || (1990 + doc_id % 40) WHEN 1 THEN 'no 20055 year' ELSE text END AS t FROM documents)""")
def report_years(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("in 1975 and 1999, YEAR:  "), (1990 + F.col("doc_id") % 40).cast("string"))).when(F.col("doc_id") % 3 == 1, "no 20055 year").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.labelled_year(t).alias("labelled"), X.first_year(t).alias("first"))


def _mined() -> str:
    return f"""WITH r AS (SELECT ['thnt', 'onst', 'les'][doc_id % 3 + 1] AS canonical, {TOKENS} AS t FROM documents
), w AS (SELECT canonical, unnest({near_sql("canonical")}) AS term FROM r) SELECT canonical, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("lexicon_mined", _mined())
def lexicon_mined(spark, d):
    docs = table(spark, d, "documents").select("text", pick(("thnt", "onst", "les"), "doc_id").alias("term"))
    return rules.mine_lexicon(docs, text="text", term="term")


# --- labels and categories -----------------------------------------------------------------------------------

FOLDERS = ("Heroin", "heroin & Cannabis", "Cannabis", "Crack Cocaine", "Alcohol", "Xanax&Alcohol", "Diazepam (Valium)", "GHB", "methamphetamine", "Unknown", "opium poppies")


def _folder(version: int) -> str:
    primary = "trim(lower(string_split(name, '" + ("&" if version == 1 else " & ") + "')[1]))"
    exact, parts = (config.PRODUCT_ALIASES, config.PRODUCTS) if version == 1 else (config.FOLDERS, config.FOLDERS)
    return f"coalesce({first_of(primary, exact, exact=True)}, {first_of(primary, parts, other=s('other'))})"


@query("folder_categories", f"SELECT name, {_folder(1)} AS v1, {_folder(2)} AS v2 FROM (SELECT unnest({list(FOLDERS)}) AS name)")
def folder_categories(spark, d):
    rows = values(spark, [(x,) for x in FOLDERS], "name string")
    return rows.select("name", rules.folder_category("name").alias("v1"), rules.folder_category("name", version=2).alias("v2"))


@query("indicator_maps", "SELECT event_id, " + first_of(pick_sql([*config.INDICATORS, "Number of Deaths"], "event_id"), config.INDICATORS, exact=True) + " AS indicator, " + first_of(pick_sql([*config.ICD10, "X00"], "event_id"), config.ICD10, exact=True) + " AS icd10 FROM events")
def indicator_maps(spark, d):
    names = pick([*config.INDICATORS, "Number of Deaths"], "event_id"), pick([*config.ICD10, "X00"], "event_id")
    return table(spark, d, "events").select("event_id", rules.map_value(names[0], config.INDICATORS).alias("indicator"), rules.map_value(names[1], config.ICD10).alias("icd10"))


SAID = ("I feel scared and hopeless", "relapsed again", "all is well", "anxiety", "my doctor says fine, nausea and vomiting")


@query("text_only_labels", f"SELECT doc_id, {label_sql('lower(t)', None)} AS v1, {label_sql('lower(t)', None, alone=True)} AS v2, {label_sql('lower(t)', 'rating')} AS rated, {how_many('lower(t)', config.DISTRESS_PHRASES)} AS n FROM (SELECT doc_id, {pick_sql(SAID, 'doc_id')} AS t, nullif(n_chars % 10, 0) AS rating FROM documents)")
def text_only_labels(spark, d):
    rows = table(spark, d, "documents").select("doc_id", pick(SAID, "doc_id").alias("t"), F.nullif(F.col("n_chars") % 10, F.lit(0)).alias("rating"))
    return rows.select("doc_id", rules.risk_label("t").alias("v1"), rules.risk_label("t", distress_alone=True).alias("v2"), rules.risk_label("t", "rating").alias("rated"), X.count_phrases("t", config.DISTRESS_PHRASES).alias("n"))


@query("route_hybrid_capped", f"""WITH {VERDICTS}, h AS (
  SELECT CASE WHEN combined_score >= 0.75 THEN 'rule_high' WHEN combined_score <= 0.1 THEN 'rule_low'
    WHEN combined_score > 0.1 AND combined_score < 0.4 AND coalesce(e.confidence >= 0.2, false) THEN 'embedding' ELSE 'llm' END AS routing FROM rule r LEFT JOIN emb e USING (post_id))
SELECT routing, CASE routing WHEN 'llm' THEN least(count(*), 5) ELSE count(*) END AS n FROM h GROUP BY 1""")
def route_hybrid_capped(spark, d):
    """The cap on calls to the model is the feature."""
    rows = rule_scores(spark, d).drop("routing").join(verdicts(spark, d)["embedding"].select("post_id", "confidence"), "post_id", "left")
    return rules.route_hybrid(rows, cap=5).groupBy("routing").agg(F.count(F.lit(1)).alias("n"))


@query("rule_probabilities", f"""WITH {catalog.RULES}, p AS (SELECT post_id, 1 - combined_score AS l, 1 - abs(combined_score - 0.35) AS m, combined_score AS h FROM rule)
SELECT post_id, round(l / (l + m + h), 6) AS low, round(m / (l + m + h), 6) AS medium, round(h / (l + m + h), 6) AS high FROM p""")
def rule_probabilities(spark, d):
    return rule_scores(spark, d).select("post_id", *[r6(c).alias(k) for k, c in metrics.rule_probabilities("combined_score").items()])


# --- reports -------------------------------------------------------------------------------------------------

LEADS = (("A_F", 2, 0.61, 0.01), ("A_F", 1, 0.74, 0.03), ("A_F", 3, 0.95, 0.2), ("A_F", -1, 0.99, 0.001), ("N_O", 1, 0.5, 0.04), ("N_O", 3, 0.5, 0.04), ("R_F", -2, 0.9, 0.001))


@query("warning_report_leads", f"""WITH {ALERTS}, c AS (SELECT * FROM (VALUES {", ".join(map(str, LEADS))}) t(topic, lead_months, r, p)
), b AS (SELECT topic, lead_months, r FROM c WHERE lead_months > 0 AND p < 0.05 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY r DESC, lead_months) = 1)
SELECT period, topic, z_score, alert_level, coalesce(printf('leads by %d months (r=%.2f)', lead_months, CAST(r AS DOUBLE)), 'no significant lead') AS lead_lag FROM alerts LEFT JOIN b USING (topic)""")
def warning_report_leads(spark, d):
    c = values(spark, list(LEADS), "topic string, lead_months int, r double, p double")
    return narrative.warning_report(alerts(spark, d).drop("alert_level"), c).select("period", "topic", "z_score", "alert_level", "lead_lag")


WEEKS = f"""WITH {POSTS}, k AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, substance AS topic, count(*) AS score FROM posts GROUP BY 1, 2
), b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY period) AS k, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd FROM k WINDOW w AS (PARTITION BY topic ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
), z AS (SELECT period, topic, round((score - m) / sd, 6) AS z_score FROM b WHERE k > 2 AND sd >= 0.001
), top AS (SELECT period, max_by(topic, (z_score, topic)) AS topic FROM z WHERE z_score >= 0.5 GROUP BY 1
), w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS period, count(*) AS post_count, avg(CAST(risk = 'high' AS INTEGER)) AS pct_high FROM posts GROUP BY 1 HAVING count(*) >= 10)"""


@query("trajectory_labels", WEEKS + """ SELECT period, post_count, CASE WHEN post_count % 5 = 0 THEN 'drift: ' || CASE WHEN post_count % 2 = 0 THEN 'toward_risk' ELSE 'unknown' END
  WHEN topic IS NOT NULL THEN 'rising: ' || topic WHEN pct_high > 0.4 THEN printf('high risk %.0f%%', 100 * pct_high) ELSE post_count || ' posts' END AS label FROM w LEFT JOIN top USING (period)""")
def trajectory_labels(spark, d):
    p = posts(spark, d)
    weeks = narrative.window_composition(p, time="ts", risk="risk")
    weeks = weeks.withColumns({"is_drift_event": F.col("post_count") % 5 == 0, "drift_direction": F.when(F.col("post_count") % 2 == 0, "toward_risk")})
    counts = series.bin_signal(p.withColumn("topic", F.col("substance")), time="ts", keys=["topic"], unit="week").withColumn("score", F.col("post_count").cast("double"))
    rising = narrative.rising_topics(counts, window=2, threshold=0.5)
    return narrative.trajectory_label(weeks, rising).select("period", "post_count", "label")


@query("spike_periods", f"WITH {catalog.DIRECTIONS}" + """, z AS (SELECT period, drift_score, coalesce((drift_score - avg(drift_score) OVER ()) / nullif(stddev_samp(drift_score) OVER (), 0) > 2, false) AS event FROM drifts)
SELECT period AS start, period + 7 AS "end", drift_score FROM z WHERE event OR NOT (SELECT bool_or(event) FROM z) ORDER BY drift_score DESC NULLS LAST, period LIMIT 12""")
def spike_periods(spark, d):
    return narrative.spike_periods(drift_windows(spark, d))


# --- evidence ------------------------------------------------------------------------------------------------


def found_near(spark, d):
    windows = narrative.spike_periods(drift_windows(spark, d))
    inside = decide.posts_in_windows(vectors(spark, d), windows, time="t")
    return inside, knn.neighbours_in_groups(inside, windows.select("start", F.array(*map(F.lit, QUERY)).alias("query_vector")), keys=["start"], id_col="vec_id", vector="embedding", k=30)


@query("neighbours_in_windows", f"WITH {EVIDENCE} SELECT start, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 30")
def neighbours_in_windows(spark, d):
    return found_near(spark, d)[1].select("start", "vec_id", r6("similarity").alias("similarity"), "rank")


@query("rerank", f"""WITH {EVIDENCE}, r AS (SELECT start, vec_id, round(similarity + (vec_id % 5) / 10.0, 9) AS score FROM ranked WHERE rank <= 30)
SELECT start, vec_id, round(score, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY start ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY start ORDER BY score DESC, vec_id) <= 10""")
def rerank(spark, d):
    def scorer(rows):
        return F.round(F.col("similarity") + F.col("vec_id") % 5 / 10, 9)

    out = knn.rerank(found_near(spark, d)[1], scorer, keys=["start"], id_col="vec_id", k=10)
    return out.select("start", "vec_id", r6("rerank_score").alias("rerank_score"), "rank")


@query("spike_summaries", f"""WITH {EVIDENCE}, many AS (SELECT start, risk, count(*) AS n FROM ranked GROUP BY 1, 2), summed AS (SELECT start, CAST(sum(n) AS BIGINT) AS n_posts, max_by(risk, (n, -ascii(risk))) AS risk, sum(n) FILTER (risk = 'high') / sum(n) AS pct_high FROM many GROUP BY 1)
SELECT start, n_posts, 's' || risk AS substance, round(coalesce(pct_high, 0), 6) AS pct_high, risk AS inferred_risk, 's' || risk || ' use with ' || risk || ' risk: relapse, withdrawal, overdose' AS query FROM summed""")
def spike_summaries(spark, d):
    inside = found_near(spark, d)[0].withColumn("substance", F.concat(F.lit("s"), "risk"))
    out = decide.spike_summaries(inside, keys=["start"], substance="substance", risk="risk")
    return decide.retrieval_query(out, substance="substance", risk="inferred_risk").withColumn("pct_high", r6("pct_high"))


@query("spike_prompts", f"""WITH {EVIDENCE} SELECT start, 'Summarise the common theme of these posts:' || chr(10) || string_agg('- post ' || vec_id, chr(10) ORDER BY rank) FILTER (rank <= 15) AS prompt FROM ranked GROUP BY 1""")
def spike_prompts(spark, d):
    rows = found_near(spark, d)[1].withColumn("text", F.concat(F.lit("post "), F.col("vec_id").cast("string")))
    return decide.spike_prompts(rows, keys=["start"], text="text")


@query("most_common", """SELECT role, w AS word, n FROM (SELECT role, w, count(*) AS n, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, w) AS k
  FROM (SELECT role, unnest(string_split(text, ' ')) AS w FROM conversations) GROUP BY 1, 2) WHERE k = 1""")
def most_common(spark, d):
    words = table(spark, d, "conversations").select("role", F.explode(F.split("text", " ")).alias("word"))
    return decide.most_common(words, ["role"], "word")


@query("nearest_label_counts", f"WITH {VECTORS}, {SEEDS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, seed_id) AS rank FROM sims) SELECT label, count(*) AS n, round(sum(similarity), 3) AS total FROM k WHERE rank <= 3 GROUP BY 1")
def nearest_label_counts(spark, d):
    """The same search with the seeds streamed in blocks past chunks of posts, as for any number of seeds."""
    v, bank = vectors(spark, d), seeds(spark, d)
    hits = knn.neighbours(v, bank, id_col="vec_id", vector="embedding", k=3, matrix_bytes=0)
    return hits.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("similarity"), 3).alias("total"))
