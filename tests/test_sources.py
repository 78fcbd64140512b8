import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import models
from tidemark.operators import series
from tidemark.plans import signal
from tidemark.sources import readers, sinks


def test_reviews(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(',drugName,condition,review,rating,date,usefulCount\n1,Oxycodone,Pain,"""I&#039;m\nshaking and sweating, ""bad""""",3,20-May-12,5\n2,Aspirin,Fever,ok,9,x,1\n3,Zed,ADHD,fine,5,2012-05-20,2\n')
    rows = {r["drugName"]: r for r in readers.read_reviews(spark, [str(p)]).collect()}
    assert set(rows) == {"Oxycodone", "Zed"}
    assert rows["Oxycodone"]["risk_level"] == "high" and rows["Oxycodone"]["substance"] == "opioid" and "I'm\nshaking" in rows["Oxycodone"]["review"]
    assert rows["Zed"]["timestamp"] == dt.datetime(2012, 5, 20) and rows["Oxycodone"]["timestamp"] == dt.datetime(2012, 5, 20)
    again = {r["drugName"]: r["post_id"] for r in readers.read_reviews(spark, [str(p)]).collect()}
    assert again == {k: r["post_id"] for k, r in rows.items()} and len(set(again.values())) == 2
    assert readers.read_reviews(spark, [str(p)], relevant_only=False).count() == 3


def test_official_counts(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text('year,month,state,state_name,indicator,data_value,predicted_value\n2020,January,KS,Kansas,Cocaine (T40.5),"1,200",\n2020,March,KS,Kansas,Heroin (T40.1),,7\n2020,March,KS,Kansas,Number of Deaths,5,5\n2020,Marchy,KS,Kansas,Heroin (T40.1),1,1\n2020,April,KS,Kansas,Heroin (T40.1),,\n')
    got = [tuple(r) for r in readers.read_official_counts(spark, str(p)).orderBy("date").collect()]
    assert got == [(dt.date(2020, 1, 1), "KS", "cocaine", 1200.0), (dt.date(2020, 3, 1), "KS", "opioid", 7.0)]


@pytest.mark.parametrize("version", [1, 2])
def test_report_tree(spark, tmp_path, version):
    for folder, n in (("heroin", 3), ("cannabis & alcohol", 3), ("rare", 1)):
        (tmp_path / folder).mkdir()
        for k in range(n):
            (tmp_path / folder / f"{k}.txt").write_text(f"<p>Year: 2004 shaking and sweating me@x.org {'word ' * (30 if k else 2)}</p>")
    rows = readers.read_experience_tree(spark, str(tmp_path), version=version, least_reports=3).collect()
    assert {r["drugName"] for r in rows} == {"heroin", "cannabis & alcohol"} and len(rows) == (6 if version == 1 else 4)
    assert {r["risk_level"] for r in rows} == {"medium" if version == 1 else "high"} and {r["timestamp"].year for r in rows} == {2004}
    assert all("[EMAIL]" in r["review"] for r in rows) and len({r["post_id"] for r in rows}) == len(rows)
    assert {r["substance"] for r in rows} == {"opioid", "other"}


def test_json_sources_and_absent_ones(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"substances": {"x": {"dominant_topic_terms": ["a", "b"], "n_docs": 3}}}, indent=1))
    (tmp_path / "s.json").write_text(json.dumps({"similarity_matrix": {"a": {"a": 1.0, "b": 0.7, "c": 0.1}}}))
    assert readers.describe_profile(readers.read_profiles(spark, str(tmp_path / "p.json"))).first()["profile"] == "x (n=3): a, b"
    assert {(r["src"], r["dst"]) for r in series.similarity_edges(readers.read_similarity(spark, str(tmp_path / "s.json"))).collect()} == {("a", "a"), ("a", "b")}
    assert readers.optional(readers.read_profiles, spark, str(tmp_path / "no.json")) is None
    (tmp_path / "e.csv").write_text("timestamp,substance,risk_level,review\n2020-01-01,x,low,a\n2020-01-01,,low,b\n")
    assert [r["source"] for r in readers.read_experience_posts(spark, str(tmp_path / "e.csv")).collect()] == ["experience"]
    (tmp_path / "bad.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.read_experience_posts(spark, str(tmp_path / "bad.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1})], "i long, a array<string>, m map<string,long>")
    for fmt in ("parquet", "json", "orc", "csv"):
        sinks.write(df, str(tmp_path / fmt), fmt=fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 1
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["i"] == "1"
    sinks.write(df, str(tmp_path / "d"), drop=["m"])
    assert spark.read.parquet(str(tmp_path / "d")).columns == ["i", "a"]
    vec = spark.createDataFrame([(1, [0.5, 1.0])], "post_id long, embedding array<double>")
    sinks.write_embeddings(vec, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).schema["embedding"].dataType.elementType.simpleString() == "float"


def test_unions(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "s")], "y int, source string")
    assert {tuple(r) for r in readers.union_sources((a, "a"), (b, "b")).select("x", "y", "source").collect()} == {(1, None, "a"), (None, 2, "s")}


def test_models(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    rows = models.HashingEncoder(16).encode(df, "t").collect()
    assert sum(x * x for x in rows[0]["embedding"]) == pytest.approx(1, abs=1e-6) and not any(rows[1]["embedding"])
    out = models.ask_model(df, None, text="t").first()
    assert out["method"] == "fallback" and out["reply"]["requires_human_review"]

    def client(prompt):
        if not prompt:
            raise RuntimeError("no")
        return '```json\n{"risk_level": "high", "confidence": 0.9}\n```'

    got = [(r["method"], r["reply"]["risk_level"]) for r in models.ask_model(df, client, text="t", retries=2, pause=0).collect()]
    assert got == [("llm", "high"), ("fallback", "medium"), ("fallback", "medium")]


def test_signal_plans(spark):
    days = [dt.date(2020 + k // 12, k % 12 + 1, 1) for k in range(36)]
    posts = spark.createDataFrame([(d, "opioid", "high") for k, d in enumerate(days) for _ in range(3 + (k * 7) % 11)], "t date, s string, risk string")
    official = spark.createDataFrame([(d, "opioid", float(10 + ((k - 3) * 7) % 11)) for k, d in enumerate(days)], "date date, substance string, deaths double")
    edges = spark.createDataFrame([("opioid", "opioid")], "src string, dst string")
    out = signal.signal_vs_official(posts, official, time="t", substance="s", risk="risk", rates=readers.denominators(spark)[0], edges=edges)
    assert out["leads"].first()["lead_months"] == 3 and out["spillover"].count() == out["spikes"].count() > 0
    alerts = out["spikes"].select("period", F.lit("relapse").alias("topic"), F.col("z").alias("z_score"), F.lit("watch").alias("alert_level"))
    topics = spark.createDataFrame([("opioid", "relapse")], "substance string, topic string")
    timely = signal.timeliness(official, alerts, out["leads"], topics)
    assert timely["mrr"].count() == 1 and timely["lag_summary"].count() == 1


def test_models_are_asked_in_turn(spark):
    def broken(prompt):
        raise RuntimeError("down")

    def talkative(prompt):
        return "I think it is high"

    def short(prompt):
        return None if "odd" in prompt else '{"risk_level": "low"}'

    df = spark.createDataFrame([(0, "a text"), (1, "an odd text"), (2, None)], "i int, t string")
    rows = {r["i"]: r for r in models.ask_model(df, [broken, talkative, short], text="t", retries=2, pause=0).collect()}
    assert [(rows[i]["method"], rows[i]["model"], rows[i]["reply"]["risk_level"]) for i in range(3)] == [("llm", "short", "low"), ("fallback", None, "medium"), ("fallback", None, "medium")]
    notes = {r["i"]: r for r in models.summarise(df, [broken, talkative], prompt="t", retries=2, pause=0).collect()}
    assert notes[0]["summary"] == "I think it is high" and notes[0]["model"] == "talkative" and notes[2]["method"] == "fallback"
    assert models.summarise(df, None, prompt="t").first()["method"] == "fallback"
