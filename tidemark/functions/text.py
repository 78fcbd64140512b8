"""Text functions over columns. All but HTML parsing, and unescaping of texts with an ampersand, stay in the JVM.

Patterns are in the subset of syntax that Java and RE2 share, but for (?U), which gives \\w and \\s their Unicode
meaning in Java. Null stays null everywhere.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Mapping
from functools import cache, reduce
from html.parser import HTMLParser
from itertools import product
from re import _parser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config

# What is cleaned and scrubbed.
URL = r"http\S+|www\.\S+"
MENTION = r"@\w+"
TAG = r"#(\w+)"
ELEMENT = r"<[^>]+>"

EMAIL = r"(?i)\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
ZIP = r"\b\d{5}(?:-\d{4})?\b"
LOOSE_EMAIL = r"\S+@\S+\.\S+"
LOOSE_PHONE = r"\b\d[\d\s\-\(\)]{7,}\d\b"
TITLED_NAME = r"\b(Mr|Mrs|Ms)\. [A-Z][a-z]+\b"
# End of fixed values.

#: What PHONE and ZIP begin with, but for the boundary: one search tells that a text has neither.
DIGITS = r"\d{3}[-.]?\d{2}"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lower(c: Column | str, low: bool) -> Column:
    return _column(c) if low else F.lower(_column(c))


def bound(c: Column | str, f: Callable[[Column], Column]) -> Column:
    """f of c, which is evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(_column(c)), f), 1)


#: Stands for a boundary of words in the strings that anchors() finds.
EDGE = "\0"


def _exact(tree, fold: bool) -> set[str] | None:
    """All strings that a part of a pattern can match, if they are few and of ASCII characters."""
    out = {""}
    for op, arg in tree:
        op, some = str(op), None
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            some = {EDGE if str(arg) == "AT_BOUNDARY" else ""}
        elif op == "LITERAL" and arg:
            some = {chr(arg)}
        elif op == "IN" and all(str(o) == "LITERAL" and a for o, a in arg):
            some = {chr(a) for _, a in arg}
        elif op == "SUBPATTERN" and not arg[1] and not arg[2]:
            some = _exact(arg[3], fold)
        elif op == "BRANCH":
            parts = [_exact(t, fold) for t in arg[1]]
            some = None if None in parts else set().union(*parts)
        if some is None or len(out) * len(some) > 64 or not all(x.isascii() for x in some):
            return None
        out = {a + (b.lower() if fold else b) for a, b in product(out, some)}
    return out


def _held(tree, fold: bool) -> set[str]:
    """Strings one of which every match of a part of a pattern holds: the set whose shortest string is the longest."""
    found, run = [], {""}
    for item in [*tree, None]:
        one = _exact([item], fold) if item else None
        if one is not None and len(run) * len(one) <= 64:
            run = {a + b for a, b in product(run, one)}
            continue
        found.append(run)
        run = {""} if one is None else one
        if one is not None or item is None:
            continue
        op, arg = str(item[0]), item[1]
        if op == "SUBPATTERN" and not arg[1] and not arg[2]:
            found.append(_held(arg[3], fold))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            found.append(_held(arg[2], fold))
        elif op == "BRANCH":
            parts = [_held(t, fold) for t in arg[1]]
            found.append(set().union(*parts) if all(parts) else set())
    least = lambda x: min(len(y.replace(EDGE, "")) for y in x)
    return max((x for x in found if x and least(x)), key=lambda x: (least(x), -len(x)), default=set())


@cache
def anchors(pattern: str) -> tuple[tuple[str, ...], bool]:
    """Strings one of which every match of a pattern holds, in lower case if it ignores case, and whether it does; no
    strings if none are certain, as for syntax that Python reads otherwise than Java. EDGE is a boundary of words."""
    if re.search(r"&&|\\v|\[[^\]]*\[", pattern):
        return (), False
    try:
        tree = _parser.parse(pattern.removeprefix("(?U)"))
    except re.error:
        return (), False
    fold = bool(tree.state.flags & re.IGNORECASE)
    if re.search(r"\(\?\w*[uU]", pattern):
        if fold:  # there Java folds more than lower case does
            return (), False
        return tuple(sorted({x.replace(EDGE, "") for x in _held(tree, fold)})), fold
    return tuple(sorted(_held(tree, fold))), fold


def may_hold(c: Column, sets: Iterable[Iterable[str]]) -> Column:
    """A number whose bit k says that c may hold a string of the k-th set, by one search a set for all its strings. The
    searches run over Arrow columns in time that does not grow with the number of strings. An EDGE next to a character
    of ASCII words is one there too, where Java may see none; others are left out: no text that holds a string is missed.
    """
    patterns = []
    for strings in sets:
        kept = {re.sub(rf"(?<!\w){EDGE}(?!\w)", "", x, flags=re.ASCII) for x in strings}
        patterns.append("|".join(r"\b".join(map(quoted, x.split(EDGE))) for x in sorted(kept)))

    @F.arrow_udf(T.LongType())
    def found(texts: pa.Array) -> pa.Array:
        out = pa.array([0] * len(texts), pa.int64())
        for k, pattern in enumerate(patterns):
            if pattern:
                hit = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
                out = pc.add(out, pc.multiply(hit.cast(pa.int64()), 1 << k))
        return out

    # Not to be copied into the expressions that use it, for these would be copied with it.
    return found.asNondeterministic()(c)


def bits(mask: Column | str, which: int) -> Column:
    """Whether one of the bits is set."""
    return _column(mask).bitwiseAND(F.lit(which).cast("long")) != 0


def holds_any(c: Column, strings: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in sorted({x.replace(EDGE, "") for x in strings})])


def possible(c: Column, pattern: str, low: Column | None = None) -> Column | None:
    """A cheap test that every text with a match passes, or None. low is c in lower case."""
    strings, fold = anchors(pattern)
    if strings:
        fold = fold and any(map(str.isalpha, "".join(strings)))
        return holds_any(c if not fold else F.lower(c) if low is None else low, strings)
    # A search for a first character is faster than one for a boundary.
    return c.rlike(pattern[2:]) if re.match(r"\\b\\d", pattern) and "|" not in pattern else None


def all_anchors(patterns: Iterable[str]) -> list[str]:
    """Strings one of which a text in lower case holds if one of the patterns, which ignore case, occurs in it; the
    empty one, which all texts hold, if that is not certain."""
    found = [anchors(p) for p in patterns]
    return [x for strings, _ in found for x in strings] if all(strings and fold for strings, fold in found) else [""]


def unless(some: Column | None, out: Column, otherwise: Column) -> Column:
    """out, or what it is known to be where some is false."""
    return out if some is None else F.when(some, out).otherwise(otherwise)


def matches(c: Column, pattern: str, low: Column | None = None) -> Column:
    """c.rlike(pattern), searched only where a match is possible."""
    first = possible(c, pattern, low)
    return c.rlike(pattern) if first is None else first & c.rlike(pattern)


def replaced(c: Column, pattern: str, new: str) -> Column:
    """regexp_replace(c, pattern, new), searched only where a match is possible."""

    def one(t: Column) -> Column:
        first = possible(t, pattern)
        out = F.regexp_replace(t, pattern, new)
        return out if first is None else F.when(first, out).otherwise(t)

    return bound(c, one)


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_html(c: Column | str) -> Column:
    """HTML entities to characters; the one cleaning step for which there is no built-in. Only texts with an ampersand go
    to Python, the others as nulls."""
    c = _column(c)
    return F.coalesce(_unescaped(F.when(F.contains(c, F.lit("&")), c)), c)


def strip_marks(c: Column | str, *, unicode: bool = True) -> Column:
    """Drops URLs, mentions, the sign of tags, and elements; then collapses white space and trims."""
    u = "(?U)" if unicode else ""
    out = _column(c)
    for pattern, new in ((URL, ""), (u + MENTION, ""), (u + TAG, "$1"), (ELEMENT, "")):
        out = replaced(out, pattern, new)
    # Runs of white space but for single spaces, which stay what they are.
    return F.trim(F.regexp_replace(out, u + r" \s+|[\s&&[^ ]]\s*", " "))


def clean(c: Column | str, *, unescape: bool = True, unicode: bool = True) -> Column:
    """Unescapes entities, then strip_marks()."""
    c = _column(c)
    return strip_marks(unescape_html(c) if unescape else c, unicode=unicode)


def scrub(c: Column | str, *, loose: bool = False, ner=None) -> Column:
    """E-mail addresses, phone numbers and ZIP codes to [EMAIL], [PHONE], [ZIP].

    loose takes the wider patterns. ner is an optional column function for names and places, applied last.
    """
    out = replaced(_column(c), LOOSE_EMAIL if loose else EMAIL, "[EMAIL]")
    if loose:
        out = replaced(replaced(out, LOOSE_PHONE, "[PHONE]"), ZIP, "[ZIP]")
    else:
        out = bound(out, lambda t: F.when(t.rlike(DIGITS), F.regexp_replace(F.regexp_replace(t, PHONE, "[PHONE]"), ZIP, "[ZIP]")).otherwise(t))
    return ner(out) if ner else out


def has_pii(c: Column | str) -> Column:
    return bound(c, lambda t: matches(t, EMAIL) | (t.rlike(DIGITS) & (t.rlike(PHONE) | t.rlike(ZIP))) | matches(t, TITLED_NAME))


def quoted(term: str) -> str:
    """term as a pattern that Java and RE2 read alike."""
    return re.sub(r"([^\w ])", r"\\\1", term)


def whole(term: str) -> str:
    """The pattern of a whole term. It looks for the term first, which is faster than to look for a boundary at each
    character, and then back at the boundary before it: it matches where one with the boundary in front does."""
    return rf"{quoted(term)}(?<=\b{quoted(term)})\b"


def _term_passes(lexicon: Mapping[str, str]) -> list[tuple[list[str], str]]:
    ordered = sorted(lexicon, key=lambda t: -len(t))
    passes: list[tuple[list[str], str]] = []
    for term in ordered:
        if passes and passes[-1][1] == lexicon[term]:
            passes[-1][0].append(term)
        else:
            passes.append(([term], lexicon[term]))
    return passes


def lexicon_passes(lexicon: Mapping[str, str]) -> list[tuple[str, str]]:
    """(pattern, canonical) in an order that equals replacing term by term, the longest first.

    Neighbouring terms with one canonical share an alternation, as long as no canonical holds a term.
    """
    return [(r"\b(?:" + "|".join(map(quoted, terms)) + r")\b", new) for terms, new in _term_passes(lexicon)]


def normalize_terms(c: Column | str, lexicon: Mapping[str, str] | None = None, *, some: Column | None = None, low: bool = False) -> Column:
    """Lower-cases and replaces whole terms by their canonical forms, the longest first. some is false only where none
    of the terms occurs; low says that c is in lower case."""
    passes = _term_passes(config.SLANG if lexicon is None else lexicon)

    def put(text: Column) -> Column:
        out = text
        for terms, new in passes:
            out = replaced(out, "|".join(map(whole, terms)), new.replace("\\", r"\\").replace("$", r"\$"))
        return unless(some, out, text)

    return bound(_lower(c, low), put)


def phrase_hits(c: Column | str, categories: Mapping[str, Iterable[str]] | None = None, *, some: Column | None = None, low: bool = False) -> Column:
    """map(category -> phrases that occur), without categories that have none; on lower case. some is false only where
    none of the phrases occurs; low says that c is in lower case."""
    categories = {k: list(v) for k, v in (config.DISTRESS_SIGNALS if categories is None else categories).items()}

    def hits(text: Column) -> Column:
        listed = lambda phrases: unless(some, F.array(*map(F.lit, phrases)), F.array().cast("array<string>"))
        parts = [x for k, v in categories.items() for x in (F.lit(k), F.filter(listed(v), lambda p: F.contains(text, p)))]
        return F.map_filter(F.create_map(*parts), lambda _, v: F.size(v) > 0)

    return bound(_lower(c, low), hits)


def count_phrases(c: Column | str, phrases: Iterable[str]) -> Column:
    """How many of the phrases occur, each once; on lower case."""
    return bound(F.lower(_column(c)), lambda text: reduce(lambda a, p: a + F.contains(text, F.lit(p)).cast("int"), phrases, F.lit(0)))


def whole_terms(c: Column | str, terms: Iterable[str], *, some: Column | None = None, low: bool = False) -> Column:
    """The sorted terms that occur as whole words. some is false only where none does; low says that c is in lower case."""
    found = lambda text: F.array(*(F.when(F.contains(text, F.lit(t)) & text.rlike(whole(t)), F.lit(t)) for t in sorted(set(terms))))
    none = F.array().cast("array<string>")
    return F.filter(bound(_lower(c, low), lambda text: unless(some, found(text), none)), lambda t: t.isNotNull())


def window_terms(c: Column | str, term: str, *, window: int = 5, stopwords: Iterable[str] | None = None) -> Column:
    """Words within window places of the first occurrence of term: of three letters or more, no stopwords, not term."""
    words = F.regexp_extract_all(F.lower(_column(c)), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    at = F.array_position(words, term)
    first = F.greatest(at - window, F.lit(1))
    near = F.slice(words, first.cast("int"), (at + window - first + 1).cast("int"))
    stop = F.array(*map(F.lit, config.STOPWORDS if stopwords is None else stopwords))
    kept = F.filter(near, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & (w != term))
    return F.when(at > 0, kept).otherwise(F.array().cast("array<string>"))


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_column(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def stable_id(prefix: str, name: Column | str, path: Column | str) -> Column:
    """prefix_slug_hash: the same for a path in every run."""
    return F.concat_ws("_", F.lit(prefix), slug(name), F.substring(F.sha1(_column(path).cast("binary")), 1, 12))


def word_count(c: Column | str) -> Column:
    trimmed = F.trim(F.regexp_replace(_column(c), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def snippet(c: Column | str, length: int = 120) -> Column:
    return F.trim(F.substring(_column(c), 1, length))


def json_body(c: Column | str) -> Column:
    """A model's reply without the fences around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_column(c)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def title_case(c: Column | str, suffix: str = "_score") -> Column:
    return F.initcap(F.replace(F.replace(_column(c), F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" ")))


def to_slang(c: Column | str, key: Column | str, lexicon: Mapping[str, str] | None = None) -> Column:
    """Canonical forms to one of their terms, picked by the hash of key: the inverse of normalize_terms()."""
    lexicon = config.SLANG if lexicon is None else lexicon
    out = F.lower(_column(c))
    for canonical in sorted(set(lexicon.values())):
        terms = sorted(t for t, v in lexicon.items() if v == canonical)
        pick = F.element_at(F.array(*map(F.lit, terms)), (F.pmod(F.xxhash64(_column(key), F.lit(canonical)), F.lit(len(terms))) + 1).cast("int"))
        out = F.regexp_replace(out, F.lit(rf"\b{quoted(canonical)}\b"), pick)
    return out


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """The visible text of HTML, parts joined by spaces, white space collapsed."""

    def parse(x: str) -> str:
        p = _Visible()
        p.feed(x)
        p.close()
        return " ".join(" ".join(p.parts).split())

    return s.map(parse, na_action="ignore")


def labelled_year(c: Column | str) -> Column:
    """The year after "Year:", or null."""
    return F.nullif(F.regexp_extract(_column(c), r"(?i)Year:\s*(\d{4})", 1), F.lit("")).cast("int")


def first_year(c: Column | str) -> Column:
    """The first year from 1980 to 2029, or null."""
    return F.nullif(F.regexp_extract(_column(c), r"\b(19[89]\d|20[012]\d)\b", 1), F.lit("")).cast("int")
