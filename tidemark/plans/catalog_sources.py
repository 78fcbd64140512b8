"""Queries over readers and writers: tables go out as files in a source's format and come back through its reader.

The files are written to the folder that spark.checkpoint.dir names, which all executors share, or to a temporary one
where a session on one machine names none.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import decide, rules, series
from tidemark.plans import inputs
from tidemark.plans.catalog import RULES, query, rule_scores, table, vectors
from tidemark.sources import readers, sinks


def place(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.mkdtemp(prefix='tidemark-')}/files-{uuid.uuid4().hex}"


def csv(df: DataFrame) -> str:
    """df as CSV files with quotes doubled and white space kept; the folder."""
    path = place(df.sparkSession)
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def json(df: DataFrame) -> str:
    path = place(df.sparkSession)
    df.coalesce(1).write.json(path)
    return path


def s(text: str) -> str:
    """text as a literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


def occurs(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {s(t)})" for t in terms) + ")"


def first_of(column: str, table_: dict, exact: bool = False, other: str = "NULL") -> str:
    test = (lambda k: f"{column} = {s(k)}") if exact else (lambda k: f"contains({column}, {s(k)})")
    return "CASE " + " ".join(f"WHEN {test(k)} THEN {s(v)}" for k, v in table_.items()) + f" ELSE {other} END"


def how_many(column: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({column}, {s(t)}) AS INTEGER)" for t in terms) + ")"


def label_sql(column: str, rating: str | None, *, alone: bool = False) -> str:
    high, distress = how_many(column, config.HIGH_RISK_PHRASES), how_many(column, config.DISTRESS_PHRASES)
    at_most = lambda k: f"coalesce({rating} <= {k}, false)" if rating else "false"
    enough = "true" if alone else at_most(3)
    return f"CASE WHEN {high} >= 1 OR ({distress} >= 2 AND {enough}) THEN 'high' WHEN {distress} >= 1 OR {at_most(4)} THEN 'medium' ELSE 'low' END"


# --- reviews, counts, posts ----------------------------------------------------------------------------------

NAMES, ILLS = ("Oxycodone 5mg", "Xanax", "Aspirin", "Adderall XR", "Naltrexone"), ("Pain", "Fever", "ADHD", "Headache")
TAIL = ("", " I&#039;m &quot;shaking&quot;, sweating &amp; scared", " fine", " a relapse")


def pick(values, number: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(number), F.lit(len(values))) + 1).cast("int"))


def pick_sql(values, number: str) -> str:
    return "[" + ", ".join(map(s, values)) + f"][{number} % {len(values)} + 1]"


REVIEWS = f"""r AS (
  SELECT doc_id, {pick_sql(NAMES, "doc_id")} AS name, {pick_sql(ILLS, "doc_id")} AS ill, CAST(doc_id % 10 + 1 AS DOUBLE) AS rating, DATE '2010-01-01' + CAST(doc_id % 3000 AS INTEGER) AS day,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) || {pick_sql([t.replace("&#039;", "'").replace("&quot;", '"').replace("&amp;", "&") for t in TAIL], "doc_id")} AS review FROM documents
), w AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%-d-%b-%y') ELSE 'some day' END AS written FROM r)"""


@query("reviews_csv", f"""WITH {REVIEWS} SELECT 'review_' || substr(sha1(concat_ws(chr(31), name, ill, review, CAST(rating AS VARCHAR), written)), 1, 16) AS post_id,
  CASE WHEN doc_id % 3 < 2 THEN CAST(day AS TIMESTAMP) END AS timestamp, {first_of("lower(name)", config.PRODUCTS, other="'other'")} AS substance, {label_sql("lower(review)", "rating")} AS risk_level,
  md5(review) AS digest, rating, doc_id % 7 AS "usefulCount" FROM w WHERE {occurs("lower(name)", config.PRODUCTS)} OR {occurs("lower(ill)", config.CONDITIONS)}""")
def reviews_csv(spark, d):
    day = F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int"))
    written = F.when(F.col("doc_id") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("doc_id") % 3 == 1, F.date_format(day, "d-MMM-yy")).otherwise("some day")
    review = F.concat(F.trim(F.regexp_replace("text", r"\s+", " ")), pick(TAIL, "doc_id"))
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("_row_id"), pick(NAMES, "doc_id").alias("drugName"), pick(ILLS, "doc_id").alias("condition"), review.alias("review"),
        (F.col("doc_id") % 10 + 1).cast("double").alias("rating"), written.alias("date"), (F.col("doc_id") % 7).alias("usefulCount"),
    )
    out = readers.read_reviews(spark, [csv(rows)])
    return out.select("post_id", "timestamp", "substance", "risk_level", F.md5(F.col("review").cast("binary")).alias("digest"), "rating", "usefulCount")


KINDS = {"1-URGENT": "Opioids (T40.1-T40.4,T40.6)", "2-HIGH": "Cocaine (T40.5)", "3-MEDIUM": "Number of Deaths", "4-NOT SPECIFIED": "Heroin (T40.1)", "5-LOW": "Alcohol-induced causes"}


@query("official_counts_csv", f"""WITH r AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, 'S' || (o_custkey % 50) AS state, {first_of(first_of("o_orderpriority", KINDS, exact=True), config.INDICATORS, exact=True)} AS substance,
    CASE WHEN o_orderkey % 10 = 0 THEN CAST(round(o_totalprice) AS DOUBLE) ELSE round(o_totalprice, 2) END AS deaths FROM orders WHERE o_orderkey % 11 <> 0)
SELECT date, state, substance, count(*) AS n, round(sum(deaths), 2) AS deaths FROM r WHERE substance IS NOT NULL GROUP BY 1, 2, 3""")
def official_counts_csv(spark, d):
    o = table(spark, d, "orders")
    month = F.when(F.col("o_orderkey") % 11 == 0, "Sometime").otherwise(F.date_format("o_orderdate", "MMMM"))
    missing = F.col("o_orderkey") % 10 == 0
    rows = o.select(
        F.year("o_orderdate").alias("year"), month.alias("month"), F.concat(F.lit("S"), F.col("o_custkey") % 50).alias("state"), F.lit("").alias("state_name"),
        rules.map_value(F.col("o_orderpriority"), KINDS).alias("indicator"), F.when(~missing, F.format_number("o_totalprice", 2)).alias("data_value"),
        F.when(missing, F.round("o_totalprice").cast("long")).alias("predicted_value"),
    )
    out = readers.read_official_counts(spark, csv(rows))
    return out.groupBy("date", "state", "substance").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("deaths"), 2).alias("deaths"))


@query("experience_posts_csv", """SELECT event_type AS substance, CASE WHEN value >= 100 THEN 'high' ELSE 'low' END AS risk_level, CASE WHEN event_id % 4 = 0 THEN 'experience' ELSE 'forum' END AS source,
  date_trunc('second', ts) AS timestamp, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY ALL""")
def experience_posts_csv(spark, d):
    level = F.when(F.col("value") >= 100, "high").otherwise("low")
    rows = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("substance"),
        level.alias("risk_level"), F.when(F.col("event_id") % 4 != 0, "forum").alias("source"),
    )
    return readers.read_experience_posts(spark, csv(rows)).groupBy("substance", "risk_level", "source", "timestamp").agg(F.count(F.lit(1)).alias("n"))


DIRS = ("heroin", "cannabis & alcohol", "Diazepam", "methamphetamine", "unknown thing")


def reports(spark, d) -> str:
    """One file for each nation in the folder of its region; those of the third region have few words."""
    body = F.concat(
        F.lit("<html><body><script>x=1</script><p>Year: 2004</p><p>Mail n"), "n_nationkey", F.lit("@example.org or call 555-123-4567, "),
        F.when(F.col("n_nationkey") % 2 == 0, "shaking and sweating").otherwise("quiet"),
        F.when(F.col("n_regionkey") == 2, "").otherwise(" one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"), F.lit("</p></body></html>"),
    )
    path = place(spark)
    rows = table(spark, d, "nation").select(pick(DIRS, "n_regionkey").alias("folder"), body.alias("value"))
    rows.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    return path


def reports_sql(version: int) -> str:
    words = "' one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen'"
    primary = f"trim(lower(string_split(dir, {s('&' if version == 1 else ' & ')})[1]))"
    exact, parts = (config.PRODUCT_ALIASES, config.PRODUCTS) if version == 1 else (config.FOLDERS, config.FOLDERS)
    return f"""WITH t AS (SELECT {pick_sql(DIRS, "n_regionkey")} AS dir, 'Year: 2004 Mail [EMAIL] or call [PHONE], ' || CASE WHEN n_nationkey % 2 = 0 THEN 'shaking and sweating' ELSE 'quiet' END
  || CASE WHEN n_regionkey = 2 THEN '' ELSE {words} END AS review, n_regionkey FROM nation)
SELECT dir, coalesce({first_of(primary, exact, exact=True)}, {first_of(primary, parts, other="'other'")}) AS substance, {label_sql("lower(review)", None, alone=version == 2)} AS risk_level,
  TIMESTAMP '2004-01-01' AS timestamp, review, 'experience' AS source, count(*) AS n FROM t {"WHERE n_regionkey <> 2" if version == 2 else ""} GROUP BY ALL"""


def _reports(spark, d, version: int) -> DataFrame:
    rows = readers.read_experience_tree(spark, reports(spark, d), version=version, least_reports=5)
    return rows.groupBy(F.col("drugName").alias("dir"), "substance", "risk_level", "timestamp", "review", "source").agg(F.count_distinct("post_id").alias("n"))


@query("experience_tree_v1", reports_sql(1))
def experience_tree_v1(spark, d):
    return _reports(spark, d, 1)


@query("experience_tree_v2", reports_sql(2))
def experience_tree_v2(spark, d):
    return _reports(spark, d, 2)


# --- profiles and graphs -------------------------------------------------------------------------------------

MORE = ("overdose", "death", "Hospital", "needle", "vomit", "withdrawal", "die", "narcan")


def profiles(spark, d) -> DataFrame:
    """A topic profile for each region: its nations and as many words of harm as its key is large, twice."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    harm = F.slice(F.array(*map(F.lit, MORE)), F.lit(1), (2 * F.col("r_regionkey")).cast("int"))
    one = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.lower("n_name"))).alias("names"), F.count(F.lit(1)).alias("n_docs"))
    one = one.select(F.lower("r_name").alias("key"), F.struct(F.concat(harm, F.col("names")).alias("dominant_topic_terms"), F.col("n_docs")).alias("p"))
    return readers.read_profiles(spark, json(one.agg(F.map_from_entries(F.collect_list(F.struct("key", "p"))).alias("substances"))))


PROFILES = f"""named AS (SELECT lower(r_name) AS substance, r_regionkey AS k, list(lower(n_name) ORDER BY lower(n_name)) AS names, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
), p AS (SELECT substance, {list(MORE)}[1:2 * k] || names AS terms, n FROM named)"""


@query("profiles_json", f"WITH {PROFILES} SELECT substance, substance || ' (n=' || n || '): ' || array_to_string(terms[1:10], ', ') AS profile FROM p")
def profiles_json(spark, d):
    return readers.describe_profile(profiles(spark, d))


@query("harm_boosts", f"""WITH {PROFILES}, h AS (SELECT substance, len(list_intersect(list_transform(terms, lambda t: lower(t)), {list(config.HARM_TERMS)})) AS n FROM p)
SELECT substance, CAST(CASE WHEN n >= 7 THEN 0.15 WHEN n >= 5 THEN 0.10 ELSE 0.05 END AS DOUBLE) AS boost FROM h WHERE n >= 3""")
def harm_boosts(spark, d):
    return rules.harm_boosts(profiles(spark, d))


@query("slang_extensions", f"""WITH {PROFILES}, t AS (SELECT substance, lower(trim(unnest(terms))) AS term FROM p)
SELECT term, min(substance) AS canonical FROM t WHERE regexp_full_match(term, '\\pL{{3,}}') AND term NOT IN ('china', 'death') GROUP BY 1""")
def slang_extensions(spark, d):
    return rules.slang_extensions(profiles(spark, d), lexicon={"china": "x"}, blocked=["death"])


@query("similarity_json", """SELECT lower(a.r_name) AS src, lower(b.r_name) AS dst, 1.0 - 0.125 * abs(a.r_regionkey - b.r_regionkey)::DOUBLE AS score FROM region a, region b
WHERE 1.0 - 0.125 * abs(a.r_regionkey - b.r_regionkey) >= 0.7""")
def similarity_json(spark, d):
    r = table(spark, d, "region").agg(F.collect_list(F.struct(F.lower("r_name").alias("name"), "r_regionkey")).alias("r"))
    row = lambda a: F.struct(a["name"].alias("k"), F.map_from_entries(F.transform("r", lambda b: F.struct(b["name"], 1.0 - 0.125 * F.abs(a["r_regionkey"] - b["r_regionkey"])))).alias("v"))
    path = json(r.select(F.map_from_entries(F.transform("r", row)).alias("similarity_matrix")))
    return series.similarity_edges(readers.read_similarity(spark, path))


# --- sinks ---------------------------------------------------------------------------------------------------


def shown(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.col("event_type").alias("kind"), "value", F.array("event_type", F.col("user_id").cast("string")).alias("tags"), F.create_map(F.lit("k"), F.col("user_id")).alias("m"))


SHOWN = "SELECT event_id, event_type AS kind, value, event_type || '+' || user_id AS tags, user_id AS k FROM events"


def _read_back(fmt: str):
    def run(spark, d):
        path = place(spark)
        df = shown(spark, d).withColumn("vector", F.array(F.lit(1.0)))
        sinks.write(df, path, fmt=fmt, drop=["vector"])
        tags, m = F.col("tags"), F.col("m")
        if fmt == "csv":
            back = spark.read.option("header", True).option("escape", "\\").schema("event_id long, kind string, value double, tags string, m string").csv(path)
            tags, m = F.from_json("tags", "array<string>"), F.from_json("m", "map<string,bigint>")
        elif fmt == "json":
            back = spark.read.schema("event_id long, kind string, value double, tags array<string>, m map<string,bigint>").json(path)
        else:
            back = spark.read.format(fmt).load(path)
        return back.select("event_id", "kind", "value", F.array_join(tags, "+").alias("tags"), m["k"].alias("k"))

    return run


for _fmt in ("csv", "json", "orc", "parquet"):
    query(f"sink_{_fmt}", SHOWN)(_read_back(_fmt))


@query("embeddings_parquet", "SELECT CAST(vec_id AS VARCHAR) AS post_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first, 'v' || vec_id AS text FROM embeddings WHERE vec_id % 9 <> 0")
def embeddings_parquet(spark, d):
    path = place(spark)
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    sinks.write_embeddings(rows, path, id_col="vec_id", text="text")
    return readers.read_embeddings(spark, path).select("post_id", F.size("embedding").cast("long").alias("n"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), "text")


# --- joined inputs -------------------------------------------------------------------------------------------


@query("classifier_outputs", f"""WITH {RULES} SELECT 'rule' AS name, count(*) AS n FROM rule UNION ALL SELECT 'embedding', count(*) FROM documents WHERE n_chars > 500
UNION ALL SELECT 'llm', count(*) FROM rule WHERE routing = 'llm'""")
def classifier_outputs(spark, d):
    base = place(spark)
    scored = rule_scores(spark, d).select("post_id", "risk_level", F.col("combined_score").alias("confidence"), "routing")
    sinks.write(scored, f"{base}/rule_based_results")
    sinks.write(scored, f"{base}/hybrid_results")
    sinks.write(table(spark, d, "documents").where("n_chars > 500").select("doc_id"), f"{base}/embedding_results")
    found = inputs.classifier_outputs(spark, base)
    out = None
    for name, df in found.items():
        if df is not None:
            one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


def judged_posts(spark, d) -> DataFrame:
    level = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").when(F.col("doc_id") % 3 > 0, "low")
    return table(spark, d, "labels").select(F.col("doc_id").alias("post_id"), level.alias("final_risk_level"))


JUDGED_POSTS = """j AS (SELECT doc_id AS post_id, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' WHEN doc_id % 3 > 0 THEN 'low' END AS final_risk_level FROM labels)"""


@query("analysis_inputs", f"WITH {JUDGED_POSTS} SELECT post_id, source, final_risk_level AS risk_level, len(embedding) AS n FROM documents JOIN j ON doc_id = post_id JOIN embeddings ON vec_id = post_id")
def analysis_inputs(spark, d):
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "source")
    emb = vectors(spark, d).select(F.col("vec_id").alias("post_id"), "embedding")
    return inputs.analysis_inputs(posts, judged_posts(spark, d), emb).select("post_id", "source", "risk_level", F.size("embedding").cast("long").alias("n"))


@query("cluster_inputs", f"WITH {JUDGED_POSTS} SELECT post_id, label % 4 - 1 AS cluster, final_risk_level FROM embeddings JOIN j ON vec_id = post_id WHERE label % 4 > 0 AND final_risk_level IS NOT NULL")
def cluster_inputs(spark, d):
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("post_id"), "embedding", (F.col("label") % 4 - 1).alias("cluster"))
    return inputs.cluster_inputs(emb.drop("cluster"), emb.select("post_id", "cluster"), judged_posts(spark, d)).select("post_id", "cluster", "final_risk_level")


@query("training_inputs", f"WITH {JUDGED_POSTS} SELECT post_id, md5(trim(text)) AS digest, final_risk_level AS risk_level FROM documents JOIN j ON doc_id = post_id WHERE final_risk_level IS NOT NULL AND len(trim(text)) > 10")
def training_inputs(spark, d):
    posts = table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "text")
    return inputs.training_inputs(judged_posts(spark, d), posts).select("post_id", F.md5(F.col("text").cast("binary")).alias("digest"), "risk_level")


@query("optional_sources", "SELECT * FROM (VALUES ('here', true), ('absent', false)) t(name, found)")
def optional_sources(spark, d):
    rows = [(name, readers.optional(lambda sp, p: sp.read.parquet(p), spark, f"{d}/{file}.parquet") is not None) for name, file in (("here", "region"), ("absent", "no such table"))]
    return spark.createDataFrame(rows, "name string, found boolean")


@query("text_column_pick", "SELECT doc_id, md5(text) AS digest FROM documents")
def text_column_pick(spark, d):
    docs = table(spark, d, "documents")
    column = decide.first_existing(docs, ["processed_text", "review", "text"])
    return docs.select("doc_id", F.md5(F.col(column).cast("binary")).alias("digest"))


def _rates_sql(values: dict, name: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({config.FIRST_RATE_YEAR + k}, {s(x)}, CAST({v} AS DOUBLE))" for x, vs in values.items() for k, v in enumerate(vs)) + f") t(year, substance, {name})"


@query("death_rates", _rates_sql(config.DEATH_RATES, "deaths_per_100k"))
def death_rates(spark, d):
    return readers.death_rates(spark)


@query("prevalence", _rates_sql(config.PREVALENCE, "population_rate_pct"))
def prevalence(spark, d):
    return readers.prevalence(spark)
