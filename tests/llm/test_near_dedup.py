import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import TEXTS
from tidemark.llm.components import UnionFind, connected_components
from tidemark.llm.near_dedup import Index, band_keys, drop_near_duplicates, near_duplicates, shingle_set, super_minhash
from tidemark.llm.queries import op2_near_dedup

SF = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent=80):
    """(id, size, component) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    where, uf = defaultdict(list), UnionFind()
    for n, (_, s) in enumerate(sets):
        uf.find(n)
        for x in s:
            where[x].append(n)
    for n, (_, s) in enumerate(sets):
        common = Counter(m for x in s for m in where[x] if m < n)
        for m, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                uf.union(n, m)
    least = {}
    for n, (i, _) in enumerate(sets):
        if i is not None:
            r = uf.find(n)
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(s), least.get(uf.find(n), i)) for n, (i, s) in enumerate(sets))


def result(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def sequential(elements, registers):
    """SuperMinHash one element after the other, with whole permutations."""
    from tidemark.llm.near_dedup import U, mix

    out = [2**64 - 1] * registers
    with np.errstate(over="ignore"):
        for e in elements:
            p = list(range(registers))
            for j in range(registers):
                r = int(mix(np.array([e + U(j + 1) * U(0x9E3779B97F4A7C15)]))[0])
                k = j + (((r >> 32) * (registers - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                out[p[j]] = min(out[p[j]], j << 32 | r & 0xFFFFFFFF)
    return out


def test_signatures_equal_the_sequential_ones():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 300)]
    got = super_minhash(sets, 24)
    assert [list(map(int, g)) for g in got] == [sequential(s, 24) for s in sets]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))
    s = super_minhash([np.concatenate([common, a]), np.concatenate([common, b])], 288)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08
    keys = band_keys(s, 48, 6)
    assert keys.shape == (2, 48) and (keys[0] == keys[1]).any()


def test_shingle_sets_have_the_size_of_the_real_ones():
    for _, t, *_ in TEXTS:
        for k in (1, 2, 3, 5):
            assert len(shingle_set(t, k)) == len(shingles(t, k))


def test_odd_rows(spark, odd_docs, no_docs):
    for k in (2, 5):
        assert result(near_duplicates(odd_docs, words=k)) == brute([(i, t) for i, t, *_ in TEXTS], k)
    assert near_duplicates(no_docs).count() == 0
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 6, 7, 8, 9, 10, None])


@pytest.mark.parametrize("blocks", [(1 << 16, 1 << 19, 64, 1 << 30), (512, 256, 6, -1)])
def test_large_group_of_near_copies(spark, monkeypatch, blocks):
    """Copies of one text with many edits: many links, and many pairs just below the threshold. Once with the real
    bounds, and once with so low ones that there are several passes, many blocks and no broadcast."""
    monkeypatch.setattr("tidemark.llm.near_dedup.MEMBERS", blocks[0])
    monkeypatch.setattr("tidemark.llm.near_dedup.QUERIES", blocks[1])
    monkeypatch.setattr("tidemark.llm.near_dedup.FIRST_QUERIES", blocks[2])
    monkeypatch.setattr("tidemark.llm.common.BROADCAST_BYTES", blocks[3])
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [f"w{rng.randint(0, 400)}"]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_duplicates(docs, words=2)) == brute(rows, 2)


def test_index_tells_what_is_linked():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 60).astype(np.uint64)
    held = [np.unique(rng.choice(pool, n)) for n in (1, 3, 20, 40, 80, 200)]
    index = Index(held)
    for n in (1, 2, 10, 40, 100, 300):
        s = np.unique(rng.choice(pool, n))
        for percent in (1, 50, 80, 100):
            common = [len(np.intersect1d(h, s)) for h in held]
            assert index.linked(s, percent).tolist() == [k for k, c in enumerate(common) if 100 * c >= percent * (len(held[k]) + len(s) - c)]


def test_only_what_the_result_reads_stays(spark, tmp_path):
    """The files of all other intermediate tables are deleted."""
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        docs = spark.createDataFrame([(i, f"a b c d e f g h i {i % 7}") for i in range(60)], "doc_id long, text string")
        got = near_duplicates(docs, words=2)
        files = [p for p in tmp_path.glob("*/rdd-*") if p.is_dir()]
        assert len(files) == 2 and got.count() == 60
    finally:
        if before:
            sc._jsc.sc().setCheckpointDir(before)


def test_query_over_the_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op2_near_dedup(spark, SF)
    assert result(got) == brute(rows, 2)


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    uf = UnionFind()
    for a, b in edges:
        uf.union(a, b)
    want = {(x, uf.find(x)) for x in uf.parent if uf.find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = connected_components(df, one_task=one_task).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert connected_components(df.limit(0), one_task=one_task).count() == 0
