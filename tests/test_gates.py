"""Searches that are left out where nothing can be found: the results are those of the plain searches."""

import random
import re

from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import text as X
from tidemark.operators import rules
from tidemark.plans import catalog, risk

SF = "/root/testdata/sf0.001"


def texts(n: int = 400) -> list[str]:
    """Terms, phrases and words of the patterns, joined by what is and is not a boundary of words."""
    rng = random.Random(3)
    words = [*config.SLANG, *config.SLANG.values(), *(p for v in config.DISTRESS_SIGNALS.values() for p in v), "fake", "empty", "script", "clean", "piss", "IV", "iv", "Mixing", "with", "fired", "due to", "family", "left", "dealer", "help me", "double", "dose", "crushing", "pill", "hide"]
    words += ["need i̇t", "İV", "Kicking", "ú", "élan", "http://x.y/z", "www.a.b", "@bob", "#tag", "<b>", "&amp;", "a@b.org", "555-123-4567", "64110-1234", "Mr. Smith", "never", "used to"]
    joins = [" ", " ", " ", "\n", " ", "  ", "\t ", "", "é", "-", "_", "́", ". "]
    out = ["".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return ["", *dict.fromkeys(out)]


def plain_clean(c):
    for pattern, new in ((X.URL, ""), ("(?U)" + X.MENTION, ""), ("(?U)" + X.TAG, "$1"), (X.ELEMENT, ""), (r"(?U)\s+", " ")):
        c = F.regexp_replace(c, pattern, new)
    c = F.trim(c)
    for pattern, new in ((X.EMAIL, "[EMAIL]"), (X.PHONE, "[PHONE]"), (X.ZIP, "[ZIP]")):
        c = F.regexp_replace(c, pattern, new)
    c = F.lower(c)
    for pattern, new in X.lexicon_passes(config.SLANG):
        c = F.regexp_replace(c, pattern, new)
    return c


def test_gates_miss_nothing(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i long, t string")
    done = risk.rule_verdicts(risk.preprocess(df, text="t", id_col="i", unescape=False))
    got = {r["post_id"]: r for r in done.collect()}
    p = F.col("p")
    any_of = lambda patterns: p.rlike("(?i)" + "|".join(f"(?:{x})" for x in patterns))
    want = df.select("i", plain_clean(F.col("t")).alias("p")).select(
        "i", "p", F.array(*[F.when(p.rlike(rf"\b{X.quoted(t)}\b"), t) for t in sorted(set(config.SLANG.values()))]).alias("subs"), any_of(config.URGENCY).alias("u"), any_of(config.ESCALATION).alias("e"),
        F.round(F.greatest(*[F.when(any_of(x), w).otherwise(0.0) for w, x in config.BEHAVIOURS.values()]), 3).alias("b"), F.lower(p).alias("low"), (p.rlike(X.EMAIL) | p.rlike(X.PHONE) | p.rlike(X.ZIP) | p.rlike(X.TITLED_NAME)).alias("pii"),
    )
    found = set()
    for r in want.collect():
        g = got[r["i"]]
        signals = {k: [x for x in v if x in r["low"]] for k, v in config.DISTRESS_SIGNALS.items()}
        assert g["processed_text"] == r["p"]
        assert g["substances_detected"] == [x for x in r["subs"] if x] and g["distress_signals"] == {k: v for k, v in signals.items() if v}
        assert g["behavior_score"] == r["b"] and (not r["u"] or g["distress_score"] >= 0.95) and (not r["e"] or g["distress_score"] >= 0.7)
        found |= {("b", r["b"]), ("u", r["u"]), ("s", bool(g["substances_detected"])), ("d", bool(g["distress_signals"]))}
    assert len(found) >= 8, found
    pii = {r["i"]: r["x"] for r in df.select("i", X.has_pii("t").alias("x")).collect()}
    assert pii == {r["i"]: r["x"] for r in df.select("i", (F.col("t").rlike(X.EMAIL) | F.col("t").rlike(X.PHONE) | F.col("t").rlike(X.ZIP) | F.col("t").rlike(X.TITLED_NAME)).alias("x")).collect()}


def test_anchors():
    assert X.anchors(r"(?i)a.{0,3}Bcd|xyz") == (("bcd", "xyz"), True)
    assert X.anchors(r"\b(the|of) (and)?\b")[0] == ("\0of ", "\0the ")
    assert X.anchors(r"(?i)x*|abc")[0] == X.anchors(r"[\s&&[^ ]]ab")[0] == X.anchors(r"(?U)(?i)\w+kab")[0] == X.anchors(r"\pLabc")[0] == ()


def test_null_texts(spark):
    df = spark.createDataFrame([(None, None)], "t string, s array<string>")
    assert df.select(X.clean("t"), X.scrub("t"), X.normalize_terms("t"), X.has_pii("t"), X.count_phrases("t", ["a"])).first() == (None,) * 5
    assert df.select(X.whole_terms("t", ["a"]), X.phrase_hits("t"), rules.substance_score("t", "s"), rules.behavior_score("t")).first() == ([], {}, 0.0, 0.0)


def test_texts_are_processed_once_and_searched_for_all_terms_at_once(spark):
    plan = catalog.QUERIES["rule_pipeline_domain"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[found", plan)) == 2 and plan.count("mary jane") <= 4


def test_described_scores_are_computed_once(spark):
    from tidemark.operators import decide

    df = catalog.QUERIES["describe_scores"](spark, SF)
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("FileScan") == 1
    one = decide.describe(spark.createDataFrame([(1.0,), (None,), (1.0,), (4.0,)], "x double"), "x").first()
    assert tuple(round(v, 6) for v in one) == (3, 2.0, 1.732051, 1.0, 1.0, 1.0, 2.5, 4.0)
    assert tuple(decide.describe(spark.createDataFrame([], "x double"), "x").first()) == (0, *[None] * 7)
    assert decide.describe(spark.createDataFrame([(7.0,)], "x double"), "x").first()["std"] is None


def test_report_searches_for_all_terms_at_once(spark):
    assert "ArrowEvalPython [found" in catalog.QUERIES["quality_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_report_counts_copies_once_without_moving_texts(spark):
    plan = catalog.QUERIES["quality_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # the one that drops copies would shuffle, and beyond a broadcast sort, all texts
    some = texts(60)
    rows = [*enumerate(some), *((100 + i, t) for i, t in enumerate(some[::2] * 3)), (900, None), (901, None)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(5)
    once = risk.quality_report(risk.preprocess(df, text="t", id_col="i")).first()
    keyed = risk.preprocess(df.withColumn("h", risk.text_hash("t")), text="t", id_col="i", carry=["h"], dedup=False)
    assert risk.quality_report(keyed, key="h").first() == once and once["n_posts"] == len(set(some)) and once["n_empty"] > 0
    none = spark.createDataFrame([], "i long, t string, h string")
    assert tuple(risk.quality_report(risk.preprocess(none, text="t", id_col="i", carry=["h"], dedup=False), key="h").first()) == (0, None, None, 0, 0, None)


def test_boundaries_behind_terms_are_those_before_them(spark):
    rng = random.Random(5)
    terms = ["les", "des", "in the", "a-b", "-x", "x.", "é", "für", "mdma"]
    parts = [*terms, *terms, "l", "x", " ", " ", "\n", "_", "-", ".", "é", "̀", "7", "中", "🙂", "İ", "[PHONE]"]
    found = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in found], "t string")
    both = [(rf"\b{X.quoted(t)}\b", X.whole(t)) for t in terms] + [(r"\b(?:" + "|".join(map(X.quoted, terms)) + r")\b", "|".join(map(X.whole, terms)))]
    checks = [F.regexp_replace("t", a, "<$0>") == F.regexp_replace("t", b, "<$0>") for a, b in both]
    assert df.agg(*[F.every(c) for c in checks]).first() == (True,) * len(checks)
    assert all(df.where(F.col("t").rlike(b)).count() > 5 for _, b in both)


def test_digits_tell_of_phones_and_zips(spark):
    rng = random.Random(7)
    parts = ["12", "345", "6789", "1", "-", ".", " ", "a", "_", "é", "٣", "a@b.org", "555-123-4567", "64110-1234"]
    df = spark.createDataFrame([("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))),) for _ in range(1500)], "t string")
    plain = F.col("t")
    for pattern, new in ((X.EMAIL, "[EMAIL]"), (X.PHONE, "[PHONE]"), (X.ZIP, "[ZIP]")):
        plain = F.regexp_replace(plain, pattern, new)
    got = df.select("t", X.scrub("t").alias("s"), plain.alias("p")).collect()
    assert [r["s"] for r in got] == [r["p"] for r in got]
    assert all(sum(mark in r["s"] for r in got) > 20 for mark in ("[EMAIL]", "[PHONE]", "[ZIP]"))


def test_rule_pipeline_drops_copies_without_moving_texts(spark):
    assert "Join" not in catalog.QUERIES["rule_pipeline_domain"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    some = texts(60)
    rows = [*((500 - i, t) for i, t in enumerate(some)), *((600 + i, t) for i, t in enumerate(some[::2] * 3)), (1, some[4]), (900, None)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(5)
    columns = ["post_id", "substance_score", "distress_score", "behavior_score", "combined_score", "risk_level", "routing"]
    want = risk.rule_verdicts(risk.preprocess(df, text="t", id_col="i")).select(*columns)
    every = risk.rule_verdicts(risk.preprocess(df.withColumn("h", risk.text_hash("t")), text="t", id_col="i", carry=["h"], dedup=False))
    got = risk.one_a_text(every.select("h", *columns), "h")
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["post_id"] for r in got.collect()} >= {1} and got.count() == len(set(some))
