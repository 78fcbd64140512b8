import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark import config
from tidemark.functions.stats import incomplete_beta, lcs_length, pearson_p
from tidemark.functions.text import lexicon_passes, quoted


@settings(max_examples=100, deadline=None)
@given(st.floats(0.2, 20), st.floats(0.2, 20), st.floats(0.01, 0.99))
def test_incomplete_beta(a, b, x):
    y = incomplete_beta(a, b, x)
    assert -1e-12 <= y <= 1 + 1e-12
    assert math.isclose(y, 1 - incomplete_beta(b, a, 1 - x), abs_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.floats(-0.99, 0.99), st.integers(3, 200))
def test_p_values_are_probabilities_and_symmetric(r, n):
    assert 0 <= pearson_p(r, n) <= 1 and math.isclose(pearson_p(r, n), pearson_p(-r, n), abs_tol=1e-12)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequences(a, b):
    n = lcs_length(a, b)
    assert n == lcs_length(b, a) <= min(len(a), len(b)) and lcs_length(a, a) == len(a)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=12))
def test_quoted_terms_match_themselves(term):
    assert re.fullmatch(quoted(term), term) if not re.search(r"[^\x20-\x7e]", term) else True


def test_passes_take_longer_terms_first():
    order = [t for p, _ in lexicon_passes(config.SLANG) for t in re.fullmatch(r"\\b\(\?:(.*)\)\\b", p)[1].split("|")]
    assert [len(t) for t in order] == sorted((len(quoted(t)) for t in config.SLANG), reverse=True) or sorted(order) == sorted(map(quoted, config.SLANG))


def test_weights_of_a_vote_sum_to_one():
    assert all(math.isclose(sum(w.values()), 1) for w in config.VOTE_WEIGHTS.values())
