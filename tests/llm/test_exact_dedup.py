from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import TEXTS
from tidemark.llm.exact_dedup import content_hash, drop_duplicates, duplicate_groups


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    pick = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return Counter((i, pick[t or ""], len(groups[t or ""]), i == pick[t or ""]) for i, t, *_ in rows)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hash_of", [content_hash, lambda t: F.unhex(F.when(F.length(t) > 20, "AA").otherwise("BB"))])
def test_groups_even_if_hashes_collide(spark, odd_docs, keep, hash_of):
    got = duplicate_groups(odd_docs, keep=keep, hash_of=hash_of).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute(TEXTS, max if keep == "largest" else min)


def test_one_row_of_each_text_stays(spark, odd_docs, no_docs):
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 4, 5, 6, 7, 8, 9, 10, None])
    assert drop_duplicates(no_docs).count() == 0


def test_many_groups_are_joined_by_shuffle(spark, odd_docs, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.BROADCAST_BYTES", -1)
    got = duplicate_groups(odd_docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute(TEXTS, max)
