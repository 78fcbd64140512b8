import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import TEXTS
from tidemark.llm import language_id
from tidemark.llm.language_id import LanguageModel, fit_languages, identify_languages, subwords, summed, train
from tidemark.llm.queries import op6_language_id

SF = "/root/testdata/sf0.01"


def test_subwords_are_those_of_the_words():
    """As many as runs of 1-4 characters in "<word>" but for the marks alone, and equal runs in equal buckets."""
    def count(words):
        return sum(max(len(f"<{w}>") - n + 1, 0) for w in words for n in (2, 3, 4)) + sum(map(len, words)) - sum(1 for _ in words[1:])

    # Neighbours share one mark, so that "a> <b" has the two-character runs "a " and " b".
    assert len(subwords("ab")) == 2 + 3 + 2 + 1
    assert Counter(subwords("ab cd")) == Counter(subwords("cd, ab!")) == Counter(subwords("ab")) + Counter(subwords("cd"))
    assert len(subwords("")) == len(subwords("12 _ ! 3")) == 0


def test_whole_long_texts_are_read(monkeypatch):
    model = LanguageModel(["a"], np.random.default_rng(1).normal(size=(1 << 15, 16)), np.zeros((16, 1)), np.zeros(1))
    text = "some words here " * 100_000 + "end"
    total, n = summed(text, model)
    once = np.bincount(subwords(text), minlength=1 << 15)
    assert n == once.sum() and np.allclose(total, once @ model.table)


def test_training_separates():
    texts = ["the cat and the dog"] * 40 + ["el gato y el perro"] * 40
    model = train(texts, np.array([0] * 40 + [1] * 40), ["en", "es"])
    totals, counts = zip(*(summed(t, model) for t in ("the bird and the cow", "el pez y el pan")), strict=True)
    assert model.logits(np.array(totals), np.array(counts)).argmax(1).tolist() == [0, 1]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = identify_languages(odd_docs, fit_languages(odd_docs)).collect()
    assert len(rows) == len(TEXTS)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {3, 4, 5} and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == "und" for r in identify_languages(odd_docs, None).collect())
    assert fit_languages(no_docs) is None and identify_languages(no_docs, None).count() == 0


def test_query_is_right_on_held_out_texts(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op6_language_id(spark, SF).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97


def test_every_language_has_its_share(spark, monkeypatch):
    """However few its rows are beside those of the others."""
    seen = Counter()
    monkeypatch.setattr(language_id, "train", lambda texts, targets, languages: seen.update(languages[k] for k in targets))
    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "CASE WHEN id % 500 = 0 THEN 'rare' WHEN id % 15000 = 1 THEN 'few' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS lang")
    few = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 60_000, 15_000))
    fit_languages(docs, sample_rows=160)
    assert seen == {"a": 41, "b": 41, "rare": 41, "few": few}


def test_whole_texts_are_learned(spark, monkeypatch):
    """Languages whose texts differ only after a long shared opening; each sampled text counts with all its subwords."""
    opening = "one shared opening of every text " * 40
    rows = [(k, opening + ("the cat and the dog " if k % 2 else "el gato y el perro ") * 60, "en" if k % 2 else "es") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(docs, fit_languages(docs)).collect()}
    assert all(got[i] == l for i, _, l in rows)
    seen = []
    monkeypatch.setattr(language_id, "train", lambda texts, targets, languages: seen.extend(texts))
    fit_languages(docs)
    assert {int(count.sum()) for _, count in seen} == {len(subwords(t)) for _, t, _ in rows}


def test_any_number_of_languages_is_learned(spark, monkeypatch):
    seen = Counter()
    monkeypatch.setattr(language_id, "train", lambda texts, targets, languages: seen.update(languages[k] for k in targets))
    docs = spark.range(6_000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "concat('l', id % 700) AS lang")
    fit_languages(docs, sample_rows=300)
    assert len(seen) == 700 and set(seen.values()) == {1}
    seen.clear()
    fit_languages(docs, sample_rows=300, most_languages=10)
    assert len(seen) == 10
