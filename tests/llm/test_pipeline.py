import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_packing import check
from tidemark.llm.toxicity import features, fit_toxicity

SF = "/root/testdata/sf0.001"


def mixed(rows, cycle=3, cap=3, seed="mix"):
    """(row, copies) by the iterative form of the targets: capped sources hand their excess to the others."""
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size[r]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: k % cycle + 1 for k, s in enumerate(order)}
    target, left, open_ = {}, sum(total.values()), set(order)
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
        open_ -= over
    u = lambda r, k: int(hashlib.md5(f"{seed}:{k}:{r[0]}".encode()).hexdigest()[:13], 16) / 16**13
    rate = {s: target[s] / total[s] if total[s] else 0 for s in total}
    off = defaultdict(lambda: [0] * 16)
    for r in rows:
        for k in range(16):
            off[r[3]][k] += size[r] * (int(rate[r[3]]) + (u(r, k) < rate[r[3]] - int(rate[r[3]])))
    best = {s: min(range(16), key=lambda k: (abs(off[s][k] - target[s]), k)) for s in total}
    for r in rows:
        yield r, int(rate[r[3]]) + (u(r, best[r[3]]) < rate[r[3]] - int(rate[r[3]]))


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    import numpy as np

    rows = [r for r in rows if (model.trees.probability(np.array([features(r[1], model.lexicon)]))[0] if model.trees else model.prior) < 0.5]
    last = {}
    for r in sorted(rows, key=lambda r: r[0]):
        last[r[1] or ""] = r
    rows = list(last.values())
    keep = {i for i, _, c in near_brute([(r[0], r[1]) for r in rows], 5) if i == c}
    rows = [r for r in rows if r[0] in keep]
    copies = {r: n for r, n in mixed(rows) if n}
    got = corpus_pipeline.run(spark, SF).collect()
    check(
        [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"], bytes(r["ids"])) for r in got],
        [(r[0], r[1]) for r, n in copies.items() for _ in range(n)],
    )


def test_each_document_is_scored_once(spark, monkeypatch):
    """However many jobs the later stages run over what the first one keeps."""
    seen, kept = spark.sparkContext.accumulator(0), {}
    first = corpus_pipeline.STAGES[0][1]

    def counted(spark, docs, sf_dir):
        out = first(spark, docs, sf_dir)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        kept["rows"] = out.count()
        return out.mapInArrow(count, out.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("toxicity", counted), *corpus_pipeline.STAGES[1:]])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert seen.value == kept["rows"] > 0


def test_stages_written_and_read_again(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            assert 0 < docs.count() <= n
            n = docs.count()


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert docs.columns == odd_docs.columns
                assert all(r["kept"] == "own kept" and r["size"] == "own size" and r["id"] == "own id" for r in docs.collect())
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) <= 10
    assert rows == []


def test_exact_stage_leaves_one_of_repeated_rows(spark, odd_docs):
    kept = corpus_pipeline.exact_dedup(spark, odd_docs, "").collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([2, 4, 5, 6, 7, 8, 9, 10, None])
