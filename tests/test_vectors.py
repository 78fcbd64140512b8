import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import clusters, decide, knn, metrics, narrative

rng = np.random.default_rng(3)


def frame(spark, x, **columns):
    rows = [(i, [float(v) for v in row], *[c[i] for c in columns.values()]) for i, row in enumerate(x)]
    kinds = {str: "string", int: "long", float: "double", dt.date: "date"}
    return spark.createDataFrame(rows, "i long, v array<double>" + "".join(f", {k} {kinds[type(c[0])]}" for k, c in columns.items()))


def test_cosine_and_centroids(spark):
    x = rng.normal(size=(40, 5))
    df = frame(spark, x, g=["a"] * 30 + ["b"] * 10)
    got = {r["g"]: r for r in V.centroids(df, ["g"], "v", least_rows=10).collect()}
    assert np.allclose(got["a"]["centroid"], x[:30].mean(0)) and got["b"]["n"] == 10
    assert V.centroids(df, ["g"], "v", least_rows=11).count() == 1
    c = df.select(V.cosine("v", F.array(*map(F.lit, [1.0, 0, 0, 0, 0]))).alias("c")).collect()
    assert np.allclose([r["c"] for r in c], x[:, 0] / np.linalg.norm(x, axis=1))
    assert frame(spark, [[0.0, 0.0]]).select(V.cosine("v", "v")).first()[0] is None


@pytest.mark.parametrize("bounds", [(1 << 24, 1 << 25, 1 << 22), (100, 400, 40)])
@pytest.mark.parametrize("per_label", [False, True])
def test_neighbours_equal_brute_force(spark, monkeypatch, bounds, per_label):
    for name, value in zip(("MATRIX_BYTES", "CHUNK_BYTES", "CELLS"), bounds, strict=True):
        monkeypatch.setattr(knn, name, value)
    monkeypatch.setattr(knn, "BLOCK", 16)
    posts, bank = rng.normal(size=(30, 6)), rng.normal(size=(50, 6))
    labels = [["high", "medium", "low"][k % 3] for k in range(50)]
    seeds = frame(spark, bank, label=labels).select(F.col("i").alias("seed_id"), F.col("v").alias("embedding"), "label")
    got = knn.neighbours(frame(spark, posts), seeds, id_col="i", vector="v", k=4, per_label=per_label).collect()
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u(posts) @ u(bank).T, 9)
    for i in range(30):
        for l in set(labels) if per_label else [None]:
            here = [k for k in range(50) if l in (None, labels[k])]
            want = sorted(here, key=lambda k: (-sims[i, k], k))[:4]
            mine = sorted((r for r in got if r["i"] == i and l in (None, r["label"])), key=lambda r: r["rank"])
            assert [r["seed_id"] for r in mine] == want


def test_no_seeds_no_posts(spark):
    seeds = frame(spark, [[1.0]], label=["high"]).select(F.col("i").alias("seed_id"), F.col("v").alias("embedding"), "label")
    assert knn.neighbours(frame(spark, [[1.0]]), seeds.limit(0), id_col="i", vector="v").count() == 0
    assert knn.neighbours(frame(spark, [[1.0]]).limit(0), seeds, id_col="i", vector="v").count() == 0


def test_classes(spark):
    bank = np.array([[1, 0], [0.9, 0.1], [0, 1], [-1, 0]], float)
    seeds = frame(spark, bank, label=["high", "high", "medium", "low"]).select(F.col("i").alias("seed_id"), F.col("v").alias("embedding"), "label")
    r = knn.classify_by_neighbours(frame(spark, [[1.0, 0.05]]), seeds, id_col="i", vector="v", k=2).first()
    assert r["risk_level"] == "high" and r["prob_low"] == 0 and r["prob_high"] + r["prob_medium"] == pytest.approx(1) and not r["needs_review"]
    r = knn.classify_by_neighbours(frame(spark, [[0.0, 1.0]]), seeds, id_col="i", vector="v", k=1, mode="global").first()
    assert (r["risk_level"], r["prob_medium"], r["confidence"]) == ("medium", 1.0, 1.0)


def test_drift_and_direction(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=7 * (k // 4)) for k in range(16)]
    x = np.repeat(np.array([[1, 0], [1, 0.1], [0.2, 1], [0, 1]], float), 4, 0)
    risk = ["high" if k % 4 else "low" for k in range(16)]
    df = frame(spark, x, t=days, risk=risk)
    rows = narrative.drift(narrative.window_centroids(df, time="t", vector="v", risk="risk", least_posts=2)).orderBy("period").collect()
    assert rows[0]["drift_score"] is None and rows[0]["drift_direction"] is None
    c = [x[4 * k] for k in range(4)]
    want = [round(1 - c[k] @ c[k - 1] / np.linalg.norm(c[k]) / np.linalg.norm(c[k - 1]), 4) for k in range(1, 4)]
    assert [r["drift_score"] for r in rows[1:]] == pytest.approx(want)
    assert rows[3]["cumulative_drift"] == pytest.approx(sum(want)) and {r["drift_direction"] for r in rows[1:]} <= {"toward_risk", "away_from_risk"}
    label = narrative.trajectory_label(narrative.drift(narrative.window_centroids(df, time="t", vector="v", least_posts=2).withColumn("high_centroid", F.lit(None).cast("array<double>"))).withColumns({"pct_high": F.lit(0.5), "post_count": F.lit(4)}), spark.createDataFrame([(dt.date(2024, 1, 8), "craving", 2.0)], "period date, topic string, z_score double"))
    assert [r["label"] for r in label.orderBy("period").collect()][:2] == ["high risk 50%", "rising: craving"]


def test_rising_topics_and_alerts(spark):
    values = [1, 2, 1, 2, 9, 2, 1.5]
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=7 * k), "t", float(v)) for k, v in enumerate(values)], "period date, topic string, score double")
    rows = narrative.warning_report(narrative.rising_topics(df)).collect()
    assert len(rows) == 1 and rows[0]["z_score"] == pytest.approx((9 - 1.5) / np.std([1, 2, 1, 2], ddof=1), abs=1e-6) and rows[0]["pct_increase"] == 500.0
    assert rows[0]["alert_level"] == "critical"
    levels = spark.createDataFrame([(3.0,), (2.0,), (1.5,)], "z_score double").select(narrative.alert_level()).collect()
    assert [r[0] for r in levels] == ["critical", "elevated", "watch"]


def test_recommendations(spark):
    rows = [(dt.date(2024, 1, 1), t, l, 12.5) for t, l in (("relapse", "critical"), ("harm_reduction", "elevated"), ("harm_reduction", "watch"), ("craving", "elevated"), ("craving", "watch"))]
    df = spark.createDataFrame(rows, "period date, topic string, alert_level string, pct_increase double")
    got = [(r["topic"], r["severity"]) for r in decide.recommendations(df).collect()]
    assert sorted(got) == sorted([("relapse", "IMMEDIATE"), ("relapse", "IMMEDIATE"), ("harm_reduction", "MONITOR"), ("harm_reduction", "INFORMATIONAL"), ("craving", "MONITOR"), ("craving", "INFORMATIONAL")])
    assert decide.recommendations(df.limit(0)).count() == 0


def test_silhouette_equals_all_distances(spark):
    x = rng.normal(size=(30, 4))
    c = [int(k % 3) for k in range(29)] + [9]
    got = {r["i"]: r["silhouette"] for r in metrics.silhouette(frame(spark, x, c=c), id_col="i", vector="v", cluster="c").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - u @ u.T
    for i in range(30):
        own = [j for j in range(30) if c[j] == c[i] and j != i]
        if not own:
            assert got[i] == 0
            continue
        a = dist[i, own].mean()
        b = min(dist[i, [j for j in range(30) if c[j] == k]].mean() for k in set(c) - {c[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_ndcg_equals_the_mean_over_orders_of_ties(spark):
    s, g = [3, 3, 2, 2, 2, 1], [0, 2, 1, 0, 2, 1]
    df = spark.createDataFrame(list(zip(map(float, s), g, strict=True)), "s double, g int")
    got = {r["k"]: r["ndcg"] for r in metrics.ndcg(df, score="s", relevance="g", ks=(1, 3, 10)).collect()}
    avg = {3: 1.0, 2: 1.0, 1: 1.0}
    for k in (1, 3, 10):
        dcg = sum(avg[x] / math.log2(n + 2) for n, x in enumerate(s) if n < k)
        ideal = sum(x / math.log2(n + 2) for n, x in enumerate(sorted(g, reverse=True)) if n < k)
        assert got[k] == pytest.approx(dcg / ideal)


def test_auc_equals_all_pairs(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 1), round(r.random(), 1)) for _ in range(120)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got["auc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()["auc"] is None


def test_f1(spark):
    df = spark.createDataFrame([("low", "low"), ("low", None), ("high", "low"), ("high", "high")], "t string, p string")
    got = {r["label"]: r for r in metrics.class_f1(df, "t", "p").collect()}
    assert got["low"]["f1"] == pytest.approx(0.8) and got["high"]["recall"] == 0.5 and got["medium"]["f1"] == 0
    assert metrics.macro_f1(metrics.class_f1(df, "t", "p")).first()[0] == pytest.approx((0.8 + 2 / 3) / 2)
    assert metrics.macro_f1(metrics.class_f1(df, "t", "p"), present_only=False).first()[0] == pytest.approx((0.8 + 2 / 3) / 3)


def test_perplexity_equals_counting(spark):
    from collections import Counter

    train, test = ["a b a", "b c"], ["a b", "c d", ""]
    uni, two = Counter(), Counter()
    for t in train:
        prev = "<s>"
        uni[prev] += 1
        for w in t.split():
            uni[w] += 1
            two[prev, w] += 1
            prev = w
    size = len(set(uni) - {"<s>"})
    mk = lambda ts: spark.createDataFrame(list(enumerate(ts)), "i long, t string")
    got = {r["i"]: r["perplexity"] for r in metrics.perplexity(mk(train), mk(test), id_col="i", text="t").collect()}
    for i, t in enumerate(test):
        logs, prev = [], "<s>"
        for w in t.split():
            logs.append(math.log((two[prev, w] + 1) / (uni[prev] + size)))
            prev = w
        assert (i in got) == bool(logs) and (not logs or got[i] == pytest.approx(math.exp(-sum(logs) / len(logs))))


def test_samples_are_stratified(spark):
    df = spark.range(1000).withColumn("l", F.when(F.col("id") < 700, "a").otherwise("b"))
    got = metrics.stratified_sample(df, label="l", key="id", n=100)
    assert {r["l"]: r["count"] for r in got.groupBy("l").count().collect()} == {"a": 70, "b": 30}
    assert got.exceptAll(metrics.stratified_sample(df.repartition(7), label="l", key="id", n=100)).count() == 0


def test_rouge(spark):
    from tidemark.functions.stats import lcs_length, rouge_l

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(3)
    for _ in range(40):
        a, b = ([r.choice("xyz") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    df = spark.createDataFrame([("the cat sat", "the cat ran"), ("", "x"), (None, "x")], "a string, b string")
    assert [x[0] for x in df.select(rouge_l("a", "b")).collect()] == [pytest.approx(2 / 3), 0.0, None]


def test_clusters_and_classifier(spark):
    x = np.concatenate([rng.normal((5, 0), 0.1, (20, 2)), rng.normal((0, 5), 0.1, (20, 2))])
    df = frame(spark, x, s=["a"] * 20 + ["b"] * 20, r=["high"] * 40)
    done = clusters.cluster_posts(df, vector="v", k=2)
    assert done.groupBy("cluster").agg(F.count_distinct("s").alias("n")).select("n").distinct().first()[0] == 1
    rows = clusters.label_clusters(done, id_col="i", vector="v", substance="s", risk="r", n=3).collect()
    assert {r["s"] for r in rows} == {"a", "b"} and all(len(r["examples"]) == 3 for r in rows)
    posts = spark.createDataFrame([(i, "bad words here now" if i % 2 else "nice words there then", "high" if i % 2 else "low") for i in range(40)], "post_id long, t string, risk string")
    out = clusters.run_inference(clusters.train_classifier(posts, text="t", label="risk"), posts, id_col="post_id")
    assert out.join(posts, "post_id").where("risk = risk_level").count() == 40


def test_evidence(spark):
    rows = [("w", k, f"text {k % 4} of it", "high" if k < 4 else "low", 1.0 - k / 10, k + 1) for k in range(7)] + [("few", 0, "x", "low", 0.1, 1)]
    df = spark.createDataFrame(rows, "w string, i long, t string, risk string, similarity double, rank int")
    got = decide.evidence_records(df, keys=["w"], id_col="i", text="t", risk="risk").collect()
    assert len(got) == 1 and got[0]["inferred_risk"] == "high" and got[0]["evidence"] == [f"text {k} of it" for k in range(4)]
    assert got[0]["confidence"] == pytest.approx(sum(1 - k / 6 for k in range(5)) / 5, abs=1e-6)


def test_spike_windows(spark):
    win = spark.createDataFrame([(dt.date(2024, 1, 1 + 7 * k), d, False) for k, d in enumerate([None, 0.1, 0.4, 0.2])], "period date, drift_score double, is_drift_event boolean")
    got = narrative.spike_periods(win, most=2).collect()
    assert [(r["start"].day, (r["end"] - r["start"]).days) for r in got] == [(22, 7), (15, 7)]
    posts = spark.createDataFrame([(dt.datetime(2024, 1, 16, 5), k) for k in range(6)] + [(dt.datetime(2024, 1, 29), 9)], "t timestamp, k int")
    assert decide.posts_in_windows(posts, narrative.spike_periods(win, most=2), time="t").count() == 6


def test_narrative_plan(spark):
    from tidemark.plans.narrative import narrative_evolution

    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    df = v.select("vec_id", "embedding", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 60).cast("int")).alias("t"), F.when(F.col("label") < 4, "high").otherwise("low").alias("risk"))
    out = narrative_evolution(df, {"relapse": [1.0] * 64, "recovery": [-1.0] * 64}, time="t", vector="embedding", risk="risk", least_posts=2)
    assert all(out[k].count() >= 0 for k in out) and out["windows"].count() > 3


def test_ranks_and_quantiles_equal_sorting(spark):
    from tidemark.operators.order import quantiles, running

    r = random.Random(6)
    values = [0.0, -0.0, 1e-310, -1e-310, 1e300, -1e300, float("inf"), *[r.choice([r.gauss(0, 1), r.gauss(0, 1e-4), float(r.randint(-3, 3)), 10 ** r.uniform(-200, 200)]) for _ in range(500)]]
    rows = [("ab"[k % 2] if k % 7 else None, v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    for down in (False, True):
        for row in running(counts, ["k"], "v", ["n"], down=down).collect():
            same = [v for k, v in rows if k == row["k"]]
            assert (row["before_n"], row["all_n"]) == (sum(v > row["v"] if down else v < row["v"] for v in same), len(same))
    some = df.where("abs(v) < 1e6").unionByName(spark.createDataFrame([("c", 4.0), ("d", None), ("d", float("nan")), ("a", float("nan"))], "k string, v double"))
    wanted = {"q10": 0.1, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    got = {x["k"]: x for x in quantiles(some, ["k"], "v", wanted).collect()}
    assert set(got) == {"a", "b", None, "c"} and got["c"]["q10"] == 4.0
    for k in ("a", "b", None):
        mine = [v for g, v in rows if g == k and abs(v) < 1e6]
        assert [got[k][n] for n in wanted] == pytest.approx([np.quantile(mine, q) for q in wanted.values()])
    assert quantiles(some.limit(0), ["k"], "v", wanted).count() == 0


def test_silhouette_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [1.0, 0.1], None)], "i long, v array<double>, c string")
    assert [(x["i"], x["silhouette"]) for x in metrics.silhouette(df, id_col="i", vector="v", cluster="c").collect()] == [(1, 0.0)]
    assert metrics.silhouette(df.limit(0), id_col="i", vector="v", cluster="c").count() == 0
