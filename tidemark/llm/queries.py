"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, labels, text_or_empty


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    pieces = pack_documents(documents(spark, sf_dir), tokenizer_json())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_fm import fit_quality, score_quality

    docs = documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, labels(spark, sf_dir)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import fit_toxicity, score_toxicity

    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, labels(spark, sf_dir)))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import scan_licenses

    found = scan_licenses(documents(spark, sf_dir))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], m["rule"]))
    licenses = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(licenses, ",").alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import fit_languages, identify_languages

    docs = documents(spark, sf_dir)
    return identify_languages(docs, fit_languages(docs))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import KINDS, scan_secrets

    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("found").alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mixing_plan

    plan = mixing_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_rules import BASE, fit_rules, judge_quality

    docs = documents(spark, sf_dir)
    rules = fit_rules(docs, labels(spark, sf_dir))
    return judge_quality(docs.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import duplicate_groups

    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(text_or_empty("text").cast("binary"), 256))
    return duplicate_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_near_dedup": op2_near_dedup,
        "op3_quality_fm": op3_quality_fm,
        "op4_toxicity": op4_toxicity,
        "op5_license_scan": op5_license_scan,
        "op6_language_id": op6_language_id,
        "op7_secret_scan": op7_secret_scan,
        "op8_mixing": op8_mixing,
        "op9_quality_rules": op9_quality_rules,
        "op10_exact_dedup": op10_exact_dedup,
    }


OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: [x]) ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS g FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON a = d.doc_id
"""

OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM totals
), rests AS (
  SELECT *,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_rest
  FROM ranked
  WINDOW before AS (ORDER BY source_size * 6 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, w_rest FROM rests WHERE 3 * source_size * w_rest > w * rest
  ORDER BY source_size * 6 / w, source NULLS LAST LIMIT 1
), targets AS (
  SELECT r.source, r.source_size,
    CASE WHEN l.rest IS NULL OR 3 * r.source_size * l.w_rest <= r.w * l.rest THEN CAST(3 * r.source_size AS DOUBLE)
         ELSE CAST(CAST(r.w * l.rest AS BIGINT) AS DOUBLE) / CAST(CAST(l.w_rest AS BIGINT) AS DOUBLE) END AS target
  FROM ranked r LEFT JOIN level l ON true
), rated AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT *, CAST(('0x' || substr(md5('mix:' || k || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS draw
  FROM rated, (SELECT unnest(range(16)) AS k)
), sums AS (
  SELECT source, k, any_value(source_size) AS source_size, any_value(rate) AS rate, any_value(target) AS target,
    CAST(sum(CASE WHEN draw < rate - floor(rate) THEN size ELSE 0 END) AS BIGINT) AS extra
  FROM drawn GROUP BY source, k
), best AS (
  SELECT source, k FROM sums
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(source_size * floor(rate) + extra - target), k) = 1
)
SELECT d.doc_id, d.size, d.source_size, d.target,
  CAST(d.size * (floor(d.rate) + CASE WHEN d.draw < d.rate - floor(d.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source AND d.k = b.k
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op8_mixing": OP8_SQL, "op10_exact_dedup": OP10_SQL}
