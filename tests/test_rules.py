import re

import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.operators import ensemble, rules
from tidemark.plans import risk


def label(spark, text, rating=None, **options):
    df = spark.createDataFrame([(text, rating)], "t string, r double")
    return df.select(rules.risk_label("t", "r", **options)).first()[0]


@pytest.mark.parametrize(
    ("text", "rating", "want"),
    [("shaking and sweating", 3.0, "high"), ("shaking and sweating", 5.0, "medium"), ("shaking and sweating", None, "medium"), ("fine", 4.0, "medium"), ("fine", 5.0, "low"), ("fine", None, "low"), ("I OVERDOSE", 9.0, "high")],
)
def test_labels(spark, text, rating, want):
    assert label(spark, text, rating) == want


def test_text_only_labels(spark):
    assert label(spark, "shaking and sweating", distress_alone=True) == "high"


def classified(spark, text, substances=(), signals=None, **options):
    df = spark.createDataFrame([("p", text, list(substances), signals or {})], "post_id string, processed_text string, substances_detected array<string>, distress_signals map<string,array<string>>")
    return risk.rule_verdicts(df, **options).first()


def test_scores(spark):
    r = classified(spark, "fentanyl", ["fentanyl"])
    assert (r["substance_score"], r["combined_score"], r["risk_level"]) == (1.0, 0.3, "medium")
    r = classified(spark, "i quit fentanyl", ["fentanyl"])
    assert (r["substance_score"], r["combined_score"], r["risk_level"]) == (0.2, 0.06, "low")
    r = classified(spark, "i used to do heroin", ["heroin"])
    assert (r["substance_score"], r["combined_score"], r["risk_level"], r["routing"]) == (0.5, 0.15, "low", "rule_based_low")
    assert classified(spark, "x", [], {"overdose": ["od'd"]})["risk_level"] == "high"
    r = classified(spark, "snorting")
    assert (r["behavior_score"], r["risk_level"]) == (0.95, "high")
    r = classified(spark, "", [], {})
    assert (r["substance_score"], r["distress_score"], r["behavior_score"], r["risk_level"]) == (0, 0, 0, "low")
    assert classified(spark, "klonopin", ["klonopin"])["substance_score"] == 0.4
    assert classified(spark, "cannabis", ["cannabis"], boosts={"cannabis": 0.15})["substance_score"] == 0.35


def test_distress(spark):
    three = {"craving": ["x"], "hopelessness": ["y"], "withdrawal": ["z"]}
    assert classified(spark, "a", [], three)["distress_score"] == 0.85
    assert classified(spark, "please help me", [], {})["distress_score"] == 0.95
    assert classified(spark, "taking more of it", [], {})["distress_score"] == 0.7
    assert classified(spark, "a", [], {"new": ["x"]})["distress_score"] == 0.5


def test_evidence(spark):
    e = classified(spark, "dealer on the darknet", ["heroin"], {"craving": ["need it", "gotta have", "fiending"]})["evidence"]
    assert e == ["Substance: heroin", "Distress: craving (phrases: need it, gotta have)", "Behavior: procurement (2 pattern matches)"]


def plain_behavior(text):
    return max([w for w, ps in config.BEHAVIOURS.values() if any(re.search(p, text, re.I) for p in ps)], default=0.0)


def test_pipeline_equals_a_plain_version(spark):
    import random

    rng = random.Random(6)
    bits = ["took oxys", "dealer", "fake pills", "never again", "used to", "can't sleep", "overdosed", "running out", "fired because of it", "nice day", "heroin", "weed", "crushing a pill", "years ago", "dope sick"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 5))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = risk.rule_verdicts(risk.preprocess(df, text="t", id_col="i")).collect()
    assert len(rows) == len(set(texts))
    for r in rows:
        t, subs, sig = r["processed_text"], r["substances_detected"], r["distress_signals"]
        assert subs == sorted({c for c in config.SLANG.values() if re.search(rf"\b{c}\b", t)})
        assert sig == {k: v for k, ps in config.DISTRESS_SIGNALS.items() if (v := [p for p in ps if p in t])}
        weight = max((config.SUBSTANCE_WEIGHTS.get(s, 0.4) for s in subs), default=0)
        s = weight * (0.2 if re.search(config.NEGATION, t) else 0.5 if re.search(config.PAST, t) else 1)
        d = max([config.DISTRESS_WEIGHTS[k] for k in sig] + [0.95] * any(re.search(p, t) for p in config.URGENCY) + [0.7] * any(re.search(p, t) for p in config.ESCALATION), default=0)
        b = plain_behavior(t)
        combined = 0.3 * round(s, 3) + 0.35 * d + 0.35 * b
        assert r["substance_score"] == pytest.approx(s, abs=5e-4) and r["distress_score"] == d and r["behavior_score"] == b
        assert r["combined_score"] == pytest.approx(combined, abs=6e-4)
        hard = "overdose" in sig or b >= 0.9 or (s >= 0.9 and d >= 0.7)
        assert r["risk_level"] == ("high" if hard or r["combined_score"] >= 0.55 else "medium" if r["combined_score"] >= 0.3 else "low")


def test_slang_does_not_lower_risk(spark):
    from tidemark.functions import text as X

    texts = [f"heroin and withdrawal, snorting it, {k} times" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("t", X.to_slang("t", "i"))
    rows = risk.rule_verdicts(risk.preprocess(df, text="t", id_col="i")).collect()
    assert sum(r["risk_level"] == "high" for r in rows) >= 0.8 * len(rows)


def test_categories(spark):
    df = spark.createDataFrame([("Hydrocodone / acetaminophen",), ("Suboxone",), ("aspirin",), (None,)], "n string")
    assert [r[0] for r in df.select(rules.product_category("n")).collect()] == ["opioid", "opioid", "other", "other"]
    dirs = spark.createDataFrame([("Cannabis & Alcohol",), ("heroin&cocaine",), ("Methamphetamine",), ("crack cocaine & x",), ("opium tea",)], "n string")
    assert [r[0] for r in dirs.select(rules.folder_category("n")).collect()] == ["other", "opioid", "stimulant", "stimulant", "other"]
    assert [r[0] for r in dirs.select(rules.folder_category("n", version=2)).collect()] == ["other", "opioid", "stimulant", "stimulant", "opioid"]
    codes = spark.createDataFrame([(" T40.5 ",), ("Z1",)], "c string")
    assert [r[0] for r in codes.select(rules.map_value(F.trim("c"), config.ICD10)).collect()] == ["cocaine", None]


def test_profiles(spark):
    df = spark.createDataFrame([("a", ["Overdose", "needle", "death", "sun"]), ("b", ["die", "died", "dying", "vomit", "inject", "needle", "death"]), ("c", ["sun"])], "substance string, dominant_topic_terms array<string>")
    assert {r["substance"]: r["boost"] for r in rules.harm_boosts(df).collect()} == {"a": 0.05, "b": 0.15}
    ext = {r["term"]: r["canonical"] for r in rules.slang_extensions(df, blocked=["sun"]).collect()}
    assert ext["needle"] == "a" and "sun" not in ext and "dope" not in ext


def test_lexicon_mining(spark):
    df = spark.createDataFrame([("my pills tramadol pills help",), ("pills with tramadol",)], "t string").withColumn("term", F.lit("tramadol"))
    assert {(r["term"], r["n"]) for r in rules.mine_lexicon(df, text="t", term="term").collect()} == {("pills", 3)}


def test_hybrid_routing(spark):
    rows = [(i, s, c) for i, (s, c) in enumerate([(0.8, None), (0.1, 0.9), (0.2, 0.3), (0.2, 0.1), (0.5, 0.9), (0.6, None)])]
    df = spark.createDataFrame(rows, "post_id long, combined_score double, confidence double")
    got = {r["post_id"]: r["routing"] for r in rules.route_hybrid(df, cap=None).collect()}
    assert got == {0: "rule_high", 1: "rule_low", 2: "embedding", 3: "llm", 4: "llm", 5: "llm"}
    assert rules.route_hybrid(df, cap=2).where("routing = 'llm'").count() == 2


def votes(spark, **levels):
    def df(level):
        return None if level is None else spark.createDataFrame([("p", level, 0.8)], "post_id string, risk_level string, confidence double")

    empty = spark.createDataFrame([], "post_id string, risk_level string, confidence double")
    both = [df(levels.get(s)) if levels.get(s) else empty for s in ("rule", "embedding")]
    return ensemble.vote(ensemble.merge_verdicts(*both, df(levels.get("llm")), df(levels.get("finetuned")))).first()


def test_votes(spark):
    r = votes(spark, rule="high", embedding="low")
    assert (r["ensemble_score"], r["final_risk_level"], r["method_agreement"], r["sources_used"]) == (0.7, "medium", False, "embedding+rule")
    r = votes(spark, rule="high")
    assert (r["ensemble_score"], r["final_risk_level"], r["method_agreement"], r["ensemble_confidence"]) == (2.0, "high", True, 0.8)
    r = votes(spark, rule="low", embedding="high", llm="high", finetuned="low")
    assert (r["ensemble_score"], r["final_risk_level"], r["sources_used"]) == (1.4, "medium", "embedding+finetuned+llm+rule")
    none = spark.createDataFrame([("p", None, None)], "post_id string, risk_level string, confidence double")
    r = ensemble.vote(ensemble.merge_verdicts(none, none)).first()
    assert (r["final_risk_level"], r["ensemble_confidence"], r["method_agreement"], r["sources_used"]) == ("low", 0.0, False, "")


def test_unusable_keys_do_not_meet(spark):
    a = spark.createDataFrame([(None, "low"), ("", "low"), ("nan", "low"), ("x", "high"), ("x", "low")], "post_id string, risk_level string")
    rows = ensemble.compare_methods(a, a).collect()
    assert [(r["post_id"], r["agree"]) for r in rows] == [("x", True)]
