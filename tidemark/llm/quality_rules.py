"""Quality rules: statistics of a text and a decision list that is learned from them.

The statistics are column expressions. Labelled rows, a bounded sample of them, teach an ordered list of
conjunctions of thresholds by sequential covering: each rule grows by information gain on one part of the
sample, is pruned on the other, and the rows it covers go. The list becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, stable_order, text_or_empty

#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "mark_rate", "mean_word", "distinct_rate", "line_words")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns BASE (long) and RATES (double).

    A three-word window is compared by a 64-bit hash. Windows are sorted with their places, equal neighbours
    are repeats, and the words they cover are counted once. All of it is array functions within the row, so
    nothing is shuffled. A null text counts as empty and has only zeros.
    """
    P = "__qr_"  # names of what is needed on the way, none of them a column of docs
    while any(c.lower().startswith(P) for c in docs.columns):
        P = "_" + P
    text = F.col(P + "text")
    words, lines, grams, found = (F.col(P + c) for c in ("words", "lines", "grams", "found"))
    out = docs.withColumn(P + "text", text_or_empty(text_col))
    out = out.withColumns(
        {
            P + "words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""),
            P + "lines": F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            P + "upper": F.regexp_count(text, F.lit("[A-Z]")),
            P + "marks": F.regexp_count(text, F.lit("[!?]")),
        }
    )
    gram = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            P + "n_lines": F.size(lines),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            P + "distinct": F.size(F.array_distinct(words)),
            P + "grams": F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), gram),
        }
    )
    numbered = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn(
        P + "found", F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(numbered))
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = F.filter(found, lambda x, k: same(x, F.get(found, k - 1)) | same(x, F.get(found, k + 1)))
    covered = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long"))
    out = out.withColumn("n_repeat_words", F.when(found.isNull(), F.lit(0).cast("long")).otherwise(F.col("n_repeat_words")))
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))
    out = out.withColumns(
        {
            "symbol_rate": per("n_symbols", "n_words"),
            "repeat_rate": per("n_repeat_words", "n_words"),
            "dup_line_rate": per("n_dup_lines", P + "n_lines"),
            "upper_rate": per(P + "upper", "word_chars"),
            "mark_rate": per(P + "marks", "n_words"),
            "mean_word": per("word_chars", "n_words"),
            "distinct_rate": per(P + "distinct", "n_words"),
            "line_words": per("n_words", P + "n_lines"),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith(P)])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, ">=" or "<=", threshold)."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & (F.col(name) >= at if sign == ">=" else F.col(name) <= at)
        return out

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, at in self.tests:
            v = x[:, names.index(name)]
            out &= v >= at if sign == ">=" else v <= at
        return out


def learn_rules(
    x: np.ndarray, bad: np.ndarray, names: list[str], *, precision: float = 0.9, least: int = 3, most_tests: int = 3, most_rules: int = 24, cuts: int = 64
) -> list[Rule]:
    """Rules for bad rows by sequential covering; each must reach the precision on the rows that prune it."""
    rng = np.random.default_rng(7)
    part = rng.random(len(x)) < 0.67
    left, rules = np.ones(len(x), bool), []
    quantiles = {n: np.unique(np.quantile(x[:, k], np.linspace(0, 1, cuts))) for k, n in enumerate(names)} if len(x) else {}
    while len(rules) < most_rules and (left & part & bad).sum() >= least:
        grown = _grown(x, bad, left & part, names, quantiles, most_tests)
        best = max((Rule(grown[:k]) for k in range(1, len(grown) + 1)), key=lambda r: _worth(r, x, bad, left & ~part, names), default=None)
        if best is None:
            break
        hit = best.covers(x, names) & left
        n, p = (hit & ~part).sum(), (hit & ~part & bad).sum()
        if p < least or p < precision * n or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(best)
        left &= ~hit
    return rules


def _worth(rule: Rule, x, bad, rows, names) -> float:
    hit = rule.covers(x, names) & rows
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n + 1)


def _grown(x, bad, rows, names, quantiles, most_tests) -> tuple:
    tests: list[tuple[str, str, float]] = []
    while len(tests) < most_tests and (rows & ~bad).any():
        p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
        base, best = math.log2((p0 + 1) / (p0 + n0 + 2)), (1e-9, None)
        for k, name in enumerate(names):
            good, wrong = x[rows & bad, k], x[rows & ~bad, k]
            good.sort(), wrong.sort()
            at = quantiles[name]
            for sign, p, n in (
                (">=", len(good) - np.searchsorted(good, at), len(wrong) - np.searchsorted(wrong, at)),
                ("<=", np.searchsorted(good, at, "right"), np.searchsorted(wrong, at, "right")),
            ):
                gain = p * (np.log2((p + 1) / (p + n + 2)) - base)
                if gain.max() > best[0]:
                    best = (gain.max(), (name, sign, float(at[gain.argmax()])))
        if best[1] is None:
            break
        tests.append(best[1])
        rows = rows & Rule((best[1],)).covers(x, names)
    return tuple(tests)


def decision_list(rules: list[Rule]) -> Column:
    """True where no rule holds: one ordered conditional expression."""
    out = None
    for rule in rules:
        out = (F if out is None else out).when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from at most sample_rows labelled rows, picked by the hash of their ids.

    No labels: no rules. Labels without an id, a label or a document are left out; null and empty texts have only zeros
    as statistics; of repeated rows each counts."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__qr_id"), F.col(label_col).alias("__qr_label"))
    picked = picked.orderBy(stable_order("__qr_id", "rules"), "__qr_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__qr_key"), F.col(text_col).alias("text")).join(small(picked, sample_rows), F.col("__qr_key") == F.col("__qr_id"))
    names = [*BASE, *RATES]
    kept = rows.select("text", F.col("__qr_id").alias("id"), F.col("__qr_label").alias("label"))
    table = np.array([list(r) for r in with_statistics(kept).select("id", "label", *names).collect()], float).reshape(-1, len(names) + 2)
    table = table[np.lexsort(table.T[::-1])]
    return learn_rules(table[:, 2:], table[:, 1] == 0, names)


def judge_quality(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """docs with its statistics (BASE, RATES), base_failed and kept.

    base_failed holds where there are fewer than least_words words, or more than most_repeated percent of them
    lie in repeated three-word windows; kept is false there, else what the decision list says. Null and empty
    texts fail. Repeated rows get equal verdicts. An empty table gives an empty one. Columns of docs that have
    these names are replaced.
    """
    out = with_statistics(docs, text_col)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & decision_list(rules))
