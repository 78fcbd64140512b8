import re
from collections import Counter

import numpy as np

from tidemark.llm.quality_rules import BASE, Rule, fit_rules, judge_quality, learn_rules
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark, odd_docs):
    got = Counter((r["doc_id"], *(r[c] for c in BASE)) for r in judge_quality(odd_docs, []).collect())
    assert got == Counter((i, *brute(t)) for i, t, *_ in TEXTS)


def test_whole_table_matches_brute_force_and_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rules = fit_rules(docs, labels)
    assert rules
    rows = judge_quality(docs, rules).collect()
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        want = brute(r["text"])
        assert tuple(r[c] for c in BASE) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    judged = [(r["kept"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.9
    assert np.mean([k for k, q in judged if q]) > 0.97


def test_rules_are_conjunctions_that_reach_the_precision():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5)
    rules = learn_rules(x, bad, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= r.covers(x, ["a", "b", "c"])
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.05 * bad.sum()
    assert learn_rules(np.empty((0, 3)), np.empty(0, bool), ["a", "b", "c"]) == []


def test_no_rows_no_labels(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert fit_rules(no_docs, labels) == []
    assert judge_quality(no_docs, [Rule((("n_words", "<=", 3.0),))]).count() == 0


def test_columns_with_any_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, __qr_text string, __QR_words int")
    row = judge_quality(docs, []).first()
    assert (row["__qr_text"], row["__QR_words"], row["n_words"]) == ("x", 7, 2)
