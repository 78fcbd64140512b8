import pytest

#: Rows that every operator must stand: nulls, empty and white-space texts, one word, ties, repeats, long texts.
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the quick brown fox", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the quick brown fox", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", "en", None),
    (6, "word", "de", "a"),
    (6, "word", "de", "a"),
    (7, "line one here\nline one here\nother line\n\n  \nline one here\n### a|b", "fr", "é"),
    (8, "long " * 9000 + "end", "es", "z"),
    (9, "Ünïcode wörds – and non-breaking spaces \U0001f600 ok", "fr", "a"),
    (10, "x" * 60_000 + " " + "Y" * 60_000 + "1z" * 20_000, "en", "b"),
    (None, "row without an id", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The rows above with extra columns whose names clash with those that operators return."""
    clashing = ("size", "source_size", "target", "copies", "keep_id", "group_size", "kept", "fp", "bands", "id", "key", "hub", "root", "rep", "component_id", "held_out", "n_words", "symbol_rate", "base_failed", "start", "length", "offset", "ids", "matches", "base", "found", "rejected", "w", "n", "rate")
    rows = [(*r, None if r[1] is None else len(r[1]), "x", 5, True, *[f"own {c}" for c in clashing]) for r in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, score int, predicted boolean, " + ", ".join(f"{c} string" for c in clashing)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
