import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import TEXTS
from tidemark.llm.packing import SlackPacker, WordIds, pack_documents
from tidemark.llm.queries import op1_packing, tokenizer_json

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(pieces, texts, capacity=4096):
    """pieces: (id, start, length, doc_tokens, sequence_id, offset, crc or ids)."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for i, start, length, n, q, offset, got in pieces:
        docs[i].append((start, length, n, got))
        sequences[q].append((offset, length))
    assert Counter({i: sum(p[1] for p in ps) for i, ps in docs.items()}) == sum((Counter({i: len(ids(t))}) for i, t in texts), Counter())
    for i, t in dict(texts).items():
        want, at = ids(t), 0
        if sum(k == i for k, _ in texts) > 1:
            continue
        for start, length, n, got in sorted(docs[i]):
            assert (start, n) == (at, len(want))
            packed = array("I", want[start : start + length]).tobytes()
            assert got in (packed, zlib.crc32(packed))
            at += length
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_words_have_the_ids_of_the_tokenizer():
    words = WordIds(tokenizer_json())
    assert words.parts is not None
    for t in ["", " ", "It's 42 o'clock, isn't it?! I'LL don't", "ÀÉÎ œuvre Łódź ŉ İstanbul straße ſ ẞ ² Ⅳ", "x<|endoftext|>y <|startoftext|> <|", "a\x1cb c\x85d e\xa0f\x00g \x7f", "é ́x ΣΑΣ 漢字 ''s 's", "\U0001f600!? #$%^&*()_+-=[]{}|;':\",./<>~`"]:
        assert list(array("I", words.of(t))) == ids(t)[:-1]
    rng = random.Random(5)
    alphabet = "abzAZ09'\"-_.,;:!?<|>sStTéÉßñÿŸœŒĳĿż×÷ªº¼́ſİµ"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9)))
        assert list(array("I", words.of(t))) == ids(t)[:-1], t


def test_closest_sum_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        packer = SlackPacker(64, 10_000)
        lengths = [rng.randint(1, 63) for _ in range(rng.randint(0, 9))]
        for k, n in enumerate(lengths):
            list(packer.add(k, n))
        room = rng.randint(0, 63)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= room}
        got = packer.closest(room)
        assert sum(n * c for n, c in got) == max(sums)
        assert not Counter(dict(got)) - Counter(lengths)


def test_odd_rows(spark, odd_docs):
    rows = pack_documents(odd_docs, tokenizer_json()).collect()
    check([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"], bytes(r["ids"])) for r in rows], [(i, t) for i, t, *_ in TEXTS])


def test_small_windows_cut_and_no_rows(spark, odd_docs, no_docs):
    rows = pack_documents(odd_docs, tokenizer_json(), capacity=16, pool_tokens=64).collect()
    check([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"], bytes(r["ids"])) for r in rows], [(i, t) for i, t, *_ in TEXTS], 16)
    assert pack_documents(no_docs, tokenizer_json()).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_over_the_whole_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    rows = op1_packing(spark, f"/root/testdata/{sf}").collect()
    check([(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["sequence_id"], r["offset"], r["ids_crc32"]) for r in rows], docs)


def test_only_tails_of_documents_wait():
    """Documents one token longer than a window: the pool bounds what waits, and it is tails, not documents."""
    packer, most = SlackPacker(64, 1 << 20, 100), 0
    pieces = []
    for k in range(5000):
        for s in packer.add(k, 65):
            pieces += s
        most = max(most, packer.pieces)
    for s in packer.finish():
        pieces += s
    assert most <= 101 and sum(p[2] for p in pieces) == 5000 * 65


def test_tails_keep_their_place(spark):
    """Documents of 4,097 tokens, whose windows go out at once and whose last tokens wait."""
    rows = [(i, "a " * 4096) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = pack_documents(docs, tokenizer_json()).selectExpr("doc_id", "start", "length", "sequence_id", "offset", "octet_length(ids) AS n").collect()
    assert Counter(r["doc_id"] for r in got) >= Counter(range(4000)) and all(r["n"] == 4 * r["length"] for r in got)
    assert sum(r["length"] for r in got) == 4000 * 4097
