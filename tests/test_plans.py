import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import decide
from tidemark.plans import evidence, inputs


def test_spike_evidence(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    rows = [(i, dt.datetime(2024, 1, 1 + i % 14, 3), [float(v) for v in x[i]], f"t{i}", "a" if i % 3 else "b", "high" if i % 4 else "low") for i in range(40)]
    posts = spark.createDataFrame(rows, "i long, t timestamp, v array<double>, text string, s string, risk string")
    windows = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 8)), (dt.date(2024, 1, 8), dt.date(2024, 1, 15)), (dt.date(2024, 2, 1), dt.date(2024, 2, 8))], "start date, end date")
    q = [1.0, -1.0, 0.5]
    queries = windows.select("start", F.array(*map(F.lit, q)).alias("query_vector"))
    out = evidence.spike_evidence(posts, windows, queries, time="t", id_col="i", vector="v", text="text", substance="s", risk="risk", retrieve=6, keep=4)
    got = {}
    for r in out["candidates"].orderBy("start", "rank").collect():
        got.setdefault(r["start"], []).append(r["i"])
    sims = np.round(x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 9)
    for start in (dt.date(2024, 1, 1), dt.date(2024, 1, 8)):
        here = [i for i in range(40) if start <= rows[i][1].date() < start + dt.timedelta(days=7)]
        assert got[start] == sorted(here, key=lambda i: (-sims[i], i))[:4]
    assert len(got) == 2 and out["evidence"].count() == 2
    s = {r["start"]: r for r in out["summaries"].collect()}
    assert s[dt.date(2024, 1, 1)]["s"] == "a" and s[dt.date(2024, 1, 1)]["query"].startswith("a use with high risk")
    p = out["prompts"].first()
    assert p["method"] == "fallback" and p["prompt"].count("\n- ") == 4


def test_spike_evidence_query_takes_all_spike_periods(spark):
    from tidemark.operators import narrative
    from tidemark.plans import catalog

    d = "/root/testdata/sf0.01"
    want = {r["start"] for r in narrative.spike_periods(catalog.drift_windows(spark, d)).collect()}
    got = {r["start"] for r in catalog.spike_evidence(spark, d).collect()}
    assert got == want and len(want) > 4, (len(got), len(want))


def test_inputs(spark, tmp_path):
    v = spark.createDataFrame([("a", "high", "llm"), ("b", None, "rule_high"), ("c", "low", "llm")], "post_id string, final_risk_level string, routing string")
    e = spark.createDataFrame([("a", [1.0]), ("c", None), ("b", [0.0])], "post_id string, embedding array<double>")
    c = spark.createDataFrame([("a", 0), ("b", -1)], "post_id string, cluster int")
    t = spark.createDataFrame([("a", " a text that is long "), ("c", "short")], "post_id string, text string")
    assert {r["post_id"] for r in inputs.analysis_inputs(t, v, e).collect()} == {"a", "c"}
    assert [r["post_id"] for r in inputs.cluster_inputs(e, c, v).collect()] == ["a"]
    assert [tuple(r) for r in inputs.training_inputs(v, t).collect()] == [("a", "a text that is long", "high")]
    for name in ("rule_based_results", "embedding_results", "hybrid_results"):
        v.write.parquet(str(tmp_path / name))
    out = inputs.classifier_outputs(spark, str(tmp_path))
    assert out["finetuned"] is None and {r["post_id"] for r in out["llm"].collect()} == {"a", "c"}


def test_small_tables(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    r = decide.describe(df, "x").first()
    assert (r["n"], r["mean"], r["q50"]) == (2, 1.5, 1.5)
    assert decide.first_existing(df, ["text", "x"]) == "x"
    lags = spark.createDataFrame([("a", -5.0), ("b", -9.0), ("c", 3.0)], "substance string, median_lag double")
    assert decide.earliest_median_lag(lags).first()["substance"] == "b"
    cors = spark.createDataFrame([("a", 1, 0.4, 0.01), ("a", 2, 0.9, 0.2), ("a", -1, 0.5, 0.04)], "substance string, shift_lag int, r double, p double")
    assert tuple(decide.best_significant_lag(cors).first()) == ("a", -1, 0.5)
    none = spark.createDataFrame([("w", None, None)], "k string, s string, risk string")
    assert decide.spike_summaries(none, keys=["k"], substance="s", risk="risk").first()["inferred_risk"] == "moderate"
    empty_report = spark.createDataFrame([], "period date, topic string, alert_level string, z_score double")
    assert decide.alert_kpis(empty_report).count() == decide.most_flagged_topic(empty_report).count() == 0
