import zlib

import numpy as np

from tests.llm.conftest import TEXTS
from tidemark.llm.queries import op4_toxicity
from tidemark.llm.toxicity import NAMES, drop_toxic, features, fit_toxicity, score_toxicity
from tidemark.llm.trees import fit_trees, isotonic

SF = "/root/testdata/sf0.1"


def test_features():
    f = dict(zip(NAMES, features("You are an IDIOT and a m0ron!! You", frozenset({"zork*"})), strict=True))
    assert f["seed_count"] == 1 and f["obfuscated_hits"] == 1 and f["second_rate"] > 0 and f["near_second"] > 0 and f["capital_rate"] > 0
    assert features(None, frozenset()) == features("", frozenset())
    assert dict(zip(NAMES, features("a zorkish word", frozenset({"zork*"})), strict=True))["learned_count"] == 1


def test_trees_learn_and_are_calibrated():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = rng.random(4000) < np.where((x[:, 0] > 0.5) & (x[:, 2] < 0.4), 0.9, 0.05)
    p = fit_trees(x, y).probability(x)
    assert (p >= 0).all() and (p <= 1).all()
    assert ((p > 0.5) == ((x[:, 0] > 0.5) & (x[:, 2] < 0.4))).mean() > 0.97
    for low, high in ((0, 0.3), (0.6, 1)):
        inside = (p >= low) & (p <= high)
        assert abs(p[inside].mean() - y[inside].mean()) < 0.05


def test_isotonic_is_monotone_and_matches_brute_force():
    rng = np.random.default_rng(4)
    s = rng.random(200)
    y = (rng.random(200) < s).astype(float)
    knots, levels = isotonic(s, y)
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= 0).all()
    # min-max formula of isotonic regression; the pseudo-rows tie with the first and the last row
    order = np.argsort(s)
    ties = [[0, 0.5, y[order[0]]], *([v] for v in y[order[1:-1]]), [y[order[-1]], 0.5, 1]]
    mean = lambda a, b: np.mean(sum(ties[a : b + 1], []))
    fit = [max(min(mean(a, b) for b in range(i, len(ties))) for a in range(i + 1)) for i in range(len(ties))]
    assert np.allclose(fit, np.interp(s[order], knots, levels), atol=1e-9)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (7, 1), (99, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = fit_toxicity(odd_docs, some)
        rows = score_toxicity(odd_docs, model).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert score_toxicity(no_docs, model).count() == 0
        kept = drop_toxic(odd_docs, model, threshold=2.0)
        assert kept.columns == odd_docs.columns and kept.count() == len(TEXTS)
        assert drop_toxic(odd_docs, model, threshold=-1.0).count() == 0


def test_query_is_right_on_held_out_texts(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([p for p, t in held if t]) > 0.85 and np.mean([p for p, t in held if not t]) < 0.01
