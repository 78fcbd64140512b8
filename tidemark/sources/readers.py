"""Readers with explicit schemas. Optional inputs give None where they are absent.

Every post gets a deterministic key at ingest, and all later joins are by key, never by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.functions import text as X
from tidemark.operators import rules
from tidemark.operators.series import latest_mean

REVIEWS = "_row_id long, drugName string, condition string, review string, rating double, date string, usefulCount long"
OFFICIAL = "year string, month string, state string, state_name string, indicator string, data_value string, predicted_value string"
EMBEDDINGS = "post_id string, embedding array<float>, text string"
PROFILES = "substances map<string,struct<dominant_topic_terms:array<string>,n_docs:long>>"
SIMILARITY = "similarity_matrix map<string,map<string,double>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern is there, asked of the path's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def optional(read, spark: SparkSession, path: str, *args, **options) -> DataFrame | None:
    return read(spark, path, *args, **options) if exists(spark, path) else None


def read_reviews(spark: SparkSession, paths: list[str], *, relevant_only: bool = True) -> DataFrame:
    """Product reviews from CSV: entities unescaped, dates parsed (null if they cannot be), only relevant rows, with
    post_id, substance and risk_level."""
    raw = spark.read.schema(REVIEWS).option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    out = raw.withColumn("review", X.unescape_html("review"))
    parsed = F.coalesce(*[F.try_to_timestamp("date", F.lit(f)) for f in ("yyyy-MM-dd", "d-MMM-yy", "MMMM d, yyyy")])
    out = out.withColumn("timestamp", parsed)
    if relevant_only:
        out = out.where(rules.is_relevant("drugName", "condition"))
    key = F.sha1(F.concat_ws("\x1f", "drugName", "condition", "review", F.col("rating").cast("string"), "date").cast("binary"))
    return out.select(
        F.concat(F.lit("review_"), F.substring(key, 1, 16)).alias("post_id"), "timestamp", rules.product_category("drugName").alias("substance"),
        rules.risk_label("review", "rating").alias("risk_level"), "review", "drugName", "rating", "usefulCount",
    )


def read_official_counts(spark: SparkSession, path: str) -> DataFrame:
    """(date, state, substance, deaths): month names parsed, indicators mapped, predicted values where data is missing."""
    raw = spark.read.schema(OFFICIAL).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    out = raw.select(
        F.try_to_timestamp(F.concat_ws(" ", "year", "month"), F.lit("yyyy MMMM")).cast("date").alias("date"), "state",
        rules.map_value(F.trim("indicator"), config.INDICATORS).alias("substance"), F.coalesce(number("data_value"), number("predicted_value")).alias("deaths"),
    )
    return out.where("date IS NOT NULL AND substance IS NOT NULL AND deaths IS NOT NULL")


def read_experience_posts(spark: SparkSession, path: str, *, source: str = "experience") -> DataFrame:
    """A prepared table of experience posts from CSV; rows without a substance are left out, a missing source is set."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    names = raw.csv(path).columns
    missing = {"timestamp", "substance", "risk_level"} - set(names)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    kinds = {"rating": "double", "usefulCount": "long", "year": "int"}
    df = raw.schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names)).csv(path)
    kept = df.where("substance IS NOT NULL").withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return kept.withColumn("source", F.coalesce("source", F.lit(source)) if "source" in df.columns else F.lit(source))


def read_experience_tree(spark: SparkSession, base: str, *, version: int = 1, least_reports: int | None = None, ner=None) -> DataFrame:
    """Experience reports from <base>/<substance>/<n>.txt, one file a row; <base>/<name>=<substance>/ is read too.

    Version 1 keeps folders of 30 files and labels by text alone; version 2 keeps folders of 5, texts of 20 words or
    more, cut to 4000 characters (a feature of that format), and takes two distress phrases alone for high. The id is
    a hash of folder and file name, the same in every run.
    """
    least = least_reports if least_reports is not None else (30 if version == 1 else 5)
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("wholetext", True).text(base)
    parts = F.split(F.regexp_replace("_metadata.file_path", "%20", " "), "/")
    folder = F.regexp_replace(F.element_at(parts, -2), "^[A-Za-z_]+=", "")  # a partition's folder counts by its value
    rows = raw.select("value", folder.alias("dir"), F.element_at(parts, -1).alias("file"))
    many = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("dir")
    rows = rows.join(many, "dir", "left_semi").withColumn("plain", X.html_text("value"))
    year = X.labelled_year("plain") if version == 1 else X.first_year("plain")
    review = X.scrub("plain", loose=version == 2, ner=ner)
    if version == 2:
        rows, review = rows.where(X.word_count("plain") >= 20), F.substring(review, 1, 4000)
    out = rows.select("dir", "file", year.alias("year"), review.alias("review"))
    return out.select(
        X.stable_id("report", "dir", F.concat_ws("/", "dir", "file")).alias("post_id"), F.to_timestamp(F.make_date("year", F.lit(1), F.lit(1))).alias("timestamp"),
        rules.folder_category("dir", version=version).alias("substance"), rules.risk_label("review", distress_alone=version == 2).alias("risk_level"), "review",
        F.col("dir").alias("drugName"), F.lit(None).cast("double").alias("rating"), F.lit("experience").alias("source"),
    )


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(substance, dominant_topic_terms, n_docs) of topic profiles in JSON."""
    raw = spark.read.schema(PROFILES).option("multiLine", True).json(path)
    return raw.select(F.explode("substances").alias("substance", "p")).select("substance", "p.dominant_topic_terms", "p.n_docs")


def describe_profile(profiles: DataFrame, *, terms: int = 10) -> DataFrame:
    """(substance, profile): the first terms and the number of documents as a line of text."""
    line = F.format_string("%s (n=%d): %s", F.col("substance"), F.coalesce("n_docs", F.lit(0)), F.array_join(F.slice("dominant_topic_terms", 1, terms), ", "))
    return profiles.select("substance", line.alias("profile"))


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """(src, scores map) of a similarity matrix in JSON; see series.similarity_edges."""
    raw = spark.read.schema(SIMILARITY).option("multiLine", True).json(path)
    return raw.select(F.explode("similarity_matrix").alias("src", "scores"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(path).where("embedding IS NOT NULL")


def _rates(spark: SparkSession, values: dict, name: str) -> DataFrame:
    rows = [(config.FIRST_RATE_YEAR + k, s, v) for s, vs in values.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("year", T.IntegerType()), T.StructField("substance", T.StringType()), T.StructField(name, T.DoubleType())]))


def prevalence(spark: SparkSession) -> DataFrame:
    """(year, substance, population_rate_pct): published national rates."""
    return _rates(spark, config.PREVALENCE, "population_rate_pct")


def death_rates(spark: SparkSession) -> DataFrame:
    """(year, substance, deaths_per_100k): published national rates."""
    return _rates(spark, config.DEATH_RATES, "deaths_per_100k")


def denominators(spark: SparkSession, table: DataFrame | None = None, *, value: str = "population_rate_pct") -> tuple[DataFrame, DataFrame]:
    """(substance, rate) as the mean of the latest three years, and the rates pivoted by year."""
    rates = (prevalence(spark) if table is None else table).withColumnRenamed(value, "rate")
    pivoted = rates.groupBy("year").pivot("substance").agg(F.avg("rate"))
    return latest_mean(rates, key="substance"), pivoted


def with_source(posts: DataFrame, source: str) -> DataFrame:
    return posts if "source" in posts.columns else posts.withColumn("source", F.lit(source))


def union_sources(*named: tuple[DataFrame, str]) -> DataFrame:
    """All rows by name, missing columns null, each with its source."""
    out = None
    for df, source in named:
        df = with_source(df, source)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
