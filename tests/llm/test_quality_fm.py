import math
import zlib

import numpy as np

from tests.llm.conftest import TEXTS
from tidemark.llm.queries import op3_quality_fm
from tidemark.llm.quality_fm import FEATURES, RANK, FactorisationMachine, WordBuckets, encode, fit_quality, score_quality, train

SF = "/root/testdata/sf0.01"


def test_the_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    fm = FactorisationMachine(0.3, rng.normal(size=FEATURES), rng.normal(size=(FEATURES, RANK)))
    for t in ("one two three two", "", "A B!! c | d"):
        index, value = encode(t, WordBuckets())
        pairs = sum(fm.factors[index[i]] @ fm.factors[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i + 1, len(index)))
        assert math.isclose(fm.margin(index, value), fm.bias + fm.linear[index] @ value + pairs, abs_tol=1e-9)


def test_interactions_are_learned():
    """Exclusive or of two words: no linear model can tell it."""
    rng = np.random.default_rng(2)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        texts.append("filler text " + "alpha " * a + "beta " * b)
        y.append(float(a != b))
    rows = [encode(t, WordBuckets()) for t in texts]
    fm = train(rows, np.array(y), epochs=30)
    assert np.mean([(fm.score(t, WordBuckets()) > 0.5) == bool(v) for t, v in zip(texts, y, strict=True)]) > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (5, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        model = fit_quality(odd_docs, some)
        rows = score_quality(odd_docs, model).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert score_quality(no_docs, model).count() == 0


def test_query_is_right_on_held_out_texts(spark):
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op3_quality_fm(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], good[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in good]
    assert np.mean([p == q for p, q in held]) > 0.93
