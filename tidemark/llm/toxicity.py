"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are rates over the whole text: words of a lexicon (a short seed list, and words and stems, that is
beginnings of longer words, which a bounded labelled sample finds almost only in toxic texts), how near they
stand to the second person, capitals, punctuation and obfuscated spellings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cells, fold, mapped, small, spread, stable_order
from tidemark.llm.trees import Trees, fit_trees

#: Labelled rows to learn from, at most, and learned lexicon words, at most.
SAMPLE_ROWS, LEXICON_WORDS = 20_000, 4_000

#: Seed words in several languages.
SEED = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown fool imbecile "
    "hate kill shut ugly vermin filth bastard bitch damn crap jerk coward liar freak "
    "idiote stupide connard connasse salaud imbécile ordure débile nul crétin "
    "dumm dummkopf trottel vollidiot arschloch abschaum versager widerlich "
    "estúpido idiota imbécil basura tonto asqueroso inútil payaso perdedor".split()
)
#: Second-person words in several languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre du dich dir dein deine ihr euch usted tú ti vosotros".split())
#: Letters of the stems that are learned; a stem is written with a star.
STEMS = (4, 5, 6)
#: What the usual obfuscations stand for.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: Bounded on all sides, so that a long run of letters costs no more than its length.
OBFUSCATED = re.compile(r"[^\W\d_]{1,30}[0134579@$!*]{1,10}[^\W\d_]{1,30}")
CAPITALS = re.compile(r"\b[^\W\d_a-z]{2,}\b")
MARKS = re.compile(r"[!?]")
RUNS = re.compile(r"[!?]{2,}|\*{2,}")

NAMES = (
    "log_words", "seed_rate", "seed_count", "learned_rate", "learned_count", "stem_rate", "near_second", "second_rate",
    "capital_rate", "mark_rate", "run_rate", "obfuscated_rate", "obfuscated_hits", "distinct_hits",
)


@dataclass
class ToxicityModel:
    lexicon: frozenset
    trees: Trees | None
    prior: float


def features(text: str | None, lexicon: frozenset, near: int = 6) -> list[float]:
    """The features NAMES of a whole text; a null text counts as empty."""
    text = text or ""
    words = TOKEN.findall(text.lower())
    n = max(len(words), 1)
    kinds = set(words)
    seeds, learned = kinds & SEED, kinds & lexicon
    stemmed = {w for w in kinds if any(w[:k] + "*" in lexicon for k in STEMS if len(w) > k)}
    learned = learned | stemmed
    hits = [k for k, w in enumerate(words) if w in seeds or w in learned] if seeds or learned else []
    n_seed = sum(words[k] in seeds for k in hits)
    n_learned = sum(words[k] in learned for k in hits)
    n_stemmed = sum(words[k] in stemmed for k in hits)
    second = kinds & SECOND_PERSON
    places = [k for k, w in enumerate(words) if w in second] if second else []
    at, close = 0, 0
    for k in hits if places else []:
        while at + 1 < len(places) and places[at + 1] <= k:
            at += 1
        close += any(abs(p - k) <= near for p in places[at : at + 2])
    disguised = OBFUSCATED.findall(text)
    undone = sum(w.lower().translate(LEET).replace("*", "") in SEED for w in disguised)
    return [
        math.log1p(len(words)), n_seed / n, min(n_seed, 20), n_learned / n, min(n_learned, 20), n_stemmed / n, close / n, len(places) / n,
        len(CAPITALS.findall(text)) / n, len(MARKS.findall(text)) / n, len(RUNS.findall(text)) / n, len(disguised) / n,
        min(undone, 20), min(len(seeds | learned), 20),
    ]


def _per_text(batches: Iterable, text: str, other: list[str], lexicon: frozenset):
    for row in cells(batches, text, *other):
        yield row[1:], features(row[0], lexicon)


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int, folds: int, held: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, text) of at most sample_rows labelled rows outside the held-out fold."""
    taught = labels.where(F.col(label_col).isNotNull() & (fold(id_col, folds) != held) & F.col(id_col).isNotNull())
    picked = taught.select(F.col(id_col).alias("__tx_id"), F.col(label_col).cast("int").alias("__tx_label"))
    picked = picked.orderBy(stable_order("__tx_id", "toxicity"), "__tx_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__tx_key"), F.col(text_col).alias("__tx_text"))
    joined = rows.join(small(picked, sample_rows), F.col("__tx_key") == F.col("__tx_id"))
    return joined.select(F.col("__tx_id").alias("id"), F.col("__tx_label").alias("label"), F.col("__tx_text").alias("text"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = SAMPLE_ROWS,
    lexicon_words: int | None = LEXICON_WORDS,
    folds: int = 5,
    held: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """A model from at most sample_rows labelled rows whose fold is not held.

    The lexicon gets the words (of three letters or more) and stems that at least three toxic texts of the sample have, and
    that are at least twenty times as common in toxic texts as in others. Half of the sample (by the hash of the
    id) teaches the lexicon and the other half the trees, so that trees see the lexicon as new texts would.
    Of these the lexicon_words that the most toxic texts have are taken, all if that is None. Without labelled rows of
    both kinds the score is the prior, 0 if nothing is labelled. Labels without an id, a label or a document are left out;
    null and empty texts count as texts without words; of repeated rows each counts.
    """
    sample = _sample(docs, labels, sample_rows, folds, held, id_col, text_col, label_col)
    teaches = F.xxhash64(F.lit("half"), "id") % 2 == 0
    # One number a text and word: lower-cased runs of letters, as features() sees most of them.
    each = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = [F.transform(F.filter(each, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    words = sample.where(teaches).select("label", F.explode(F.array_distinct(F.concat(each, *stems))).alias("w"))
    counts = words.where(F.length("w") >= 3).groupBy("w").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).where("bad >= 3")
    totals = sample.where(teaches).agg(F.sum("label"), F.count(F.lit(1))).first()
    bad_texts, texts = totals[0] or 0, totals[1] or 0
    clean_texts = max(texts - bad_texts, 1)
    often = (F.col("bad") / max(bad_texts, 1)) >= 20 * ((F.col("n") - F.col("bad") + 0.5) / clean_texts)
    common = counts.where(often).orderBy(F.desc("bad"), "w")
    top = (common if lexicon_words is None else common.limit(lexicon_words)).collect()
    lexicon = frozenset(r["w"] for r in top)

    def run(batches):
        import pyarrow as pa

        rows = [(*r, *f) for r, f in _per_text(batches, "text", ["id", "label"], lexicon)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([str(r[0]) for r in rows]), *[pa.array([float(r[k]) for r in rows]) for k in range(1, len(NAMES) + 2)]], ["id", "label", *NAMES])

    table = mapped(sample.where(~teaches), run, "id string, " + ", ".join(f"{c} double" for c in ("label", *NAMES))).collect()
    table.sort()
    data = np.array([r[1:] for r in table], float).reshape(-1, len(NAMES) + 1)
    y = data[:, 0] > 0
    prior = float(bad_texts / texts) if texts else 0.0
    if not y.any() or y.all():
        return ToxicityModel(lexicon, None, prior)
    return ToxicityModel(lexicon, fit_trees(data[:, 1:], y), prior)


def _scores(model: ToxicityModel, batch, text_col: str) -> np.ndarray:
    """The scores of an Arrow batch, some rows at a time, so that few texts are Python strings at once."""
    out, held = [], []
    for (text,) in cells([batch], text_col):
        held.append(features(text, model.lexicon) if model.trees else ())
        if len(held) == 1024:
            out.append(model.trees.probability(np.array(held)) if model.trees else np.full(len(held), model.prior))
            held = []
    if held:
        out.append(model.trees.probability(np.array(held)) if model.trees else np.full(len(held), model.prior))
    return np.concatenate(out) if out else np.empty(0)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, folds: int = 5, held: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, held_out, score and predicted for each row of docs.

    Every row is scored alone from its whole text; labels, language, source and id are no inputs. Repeated rows
    score alike, null and empty texts as texts without words, a null id is in the fold of the empty text. Other
    columns are ignored. An empty table gives an empty one.
    """
    rows = spread(docs.select(id_col, text_col)).select(id_col, (fold(id_col, folds) == held).alias("held_out"), text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(_scores(model, batch, text_col), pa.float64())], [f.name for f in schema])

    return mapped(rows, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns. Edge cases as in score_toxicity()."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch, text_col) < threshold))

    return mapped(spread(docs), run, docs.schema)
