from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.components import UnionFind
from tidemark.llm.near_dedup import fingerprint, shingle_set
from tidemark.llm.packing import SlackPacker, chunks
from tidemark.llm.secret_scan import base_spans, scan
from tidemark.llm.trees import isotonic


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([8, 16, 64]), st.sampled_from([16, 128, 4096]))
def test_packing_loses_and_pads_nothing(lengths, capacity, pool):
    packer = SlackPacker(capacity, pool)
    out = [s for k, n in enumerate(lengths) for s in packer.add(k, n)] + list(packer.finish())
    pieces = sorted((k, start, n) for s in out for k, start, n in s)
    for k, n in enumerate(lengths):
        at = 0
        for _, start, size in (p for p in pieces if p[0] == k):
            assert start == at
            at += size
        assert at == n
    sizes = [sum(n for _, _, n in s) for s in out]
    assert all(x == capacity or x < capacity and x & (x - 1) == 0 for x in sizes)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400), st.integers(1, 50))
def test_chunks_are_the_text_cut_at_white_space(text, size):
    parts = list(chunks(text, size))
    assert "".join(parts) == text
    assert all(p[0] in " \n" for p in parts[1:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "C", "d\n", "\t"]), max_size=30), st.integers(1, 5))
def test_shingle_sets_ignore_white_space_and_case(words, k):
    a, b = shingle_set(" ".join(words), k), shingle_set("  \n ".join(words).upper(), k)
    assert fingerprint(a) == fingerprint(b)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="apitokenkey_=:'\" AKI0123456789abcdef\n", max_size=300))
def test_found_spans_hold_the_base_ones(text):
    base, found = scan(text)
    assert base == base_spans(text) and set(base) <= set(found)
    assert all(0 <= a < b <= len(text) for a, b, _ in found)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.booleans()), min_size=1, max_size=60))
def test_calibration_is_monotone(rows):
    import numpy as np

    knots, levels = isotonic(np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]))
    assert (np.diff(knots) >= 0).all() and (np.diff(levels) >= -1e-12).all() and 0 < levels[0] and levels[-1] < 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
def test_roots_are_the_smallest_members(pairs):
    uf = UnionFind()
    for a, b in pairs:
        uf.union(a, b)
    for x in list(uf.parent):
        assert uf.find(x) == min(y for y in uf.parent if uf.find(y) == uf.find(x))
