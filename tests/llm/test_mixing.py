from collections import Counter, defaultdict

import pytest
from tests.llm.conftest import TEXTS
from tests.llm.test_pipeline import mixed
from tidemark.llm.mixing import mix_sources, mixing_plan


def clean(docs):
    return docs.select("doc_id", "text", "lang", "source")


def test_plan_matches_brute_force(spark, odd_docs, no_docs):
    rows = [t for t in TEXTS if t[0] is not None]
    want = Counter((r[0], n) for r, n in mixed(rows))
    docs = clean(odd_docs.where("doc_id is not null"))
    got = Counter((r["doc_id"], r["copies"]) for r in mixing_plan(docs).collect())
    assert got == want
    assert mixing_plan(no_docs).count() == 0
    assert mixing_plan(odd_docs).count() == len(TEXTS)


def test_mix_emits_copies_with_the_columns_of_docs(spark, odd_docs):
    plan = mixing_plan(odd_docs).collect()
    mix = mix_sources(odd_docs)
    assert mix.columns == odd_docs.columns
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mix.collect()) == +want


def test_targets_over_many_sources(spark):
    rows = [(i, "w " * ((i * 37) % 90), "en", None if i % 11 == 10 else f"s{i % 11 if i % 3 else 0}") for i in range(3000)]
    plan = mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    got = {r["doc_id"]: r for r in plan}
    taken, target, size = defaultdict(int), {}, {}
    for r, n in mixed(rows):
        assert got[r[0]]["copies"] == n <= 3
        taken[r[3]] += n * got[r[0]]["size"]
        target[r[3]], size[r[3]] = got[r[0]]["target"], got[r[0]]["source_size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert target[s] <= 3 * size[s] and abs(taken[s] - target[s]) < 0.02 * target[s] + 90


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing_plan(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_one_try_draws_with_the_probability_of_the_fraction(spark):
    """Sources of one document each: with one seed a copy is drawn as often as its fraction says."""
    rows = [(i, "w " * (10 if i % 2 else 30), f"s{i:05d}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing_plan(docs, tries=1).collect()
    rate = sum(r["target"] / r["source_size"] for r in plan) / len(plan)
    assert abs(sum(r["copies"] for r in plan) / len(plan) - rate) < 0.03
    some = [r for r in plan if 0.2 < r["target"] / r["source_size"] % 1 < 0.5]
    want = sum(r["target"] / r["source_size"] % 1 for r in some) / len(some)
    got = sum(r["copies"] > int(r["target"] / r["source_size"]) for r in some) / len(some)
    assert some and abs(got - want) < 0.05
