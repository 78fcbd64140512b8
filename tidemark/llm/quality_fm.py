"""Quality by a factorisation machine over hashed words, structure statistics and length metadata.

The score is a sigmoid of bias, linear weights and all pairwise interactions of a low rank. With the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2) it costs time linear in the
number of words. Values are scaled so that a text of any length has the same total weight on its words.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cells, fold, mapped, small, spread, stable_order

#: Labelled rows to learn from, at most.
SAMPLE_ROWS = 12_000
BUCKETS, RANK = 1 << 14, 8
#: Distinct words whose buckets a task remembers.
CACHED_WORDS = 200_000

#: Statistics of a text, each cut into bins at these points; a bin is one feature.
STRUCTURE = {
    "log_words": [1, 2, 3, 4, 5, 6, 7, 8, 9],
    "log_chars": [2, 4, 5, 6, 7, 8, 9, 10, 11],
    "symbol_rate": [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "upper_rate": [0.005, 0.01, 0.02, 0.05, 0.1, 0.3, 0.6],
    "mark_rate": [0.005, 0.02, 0.05, 0.1, 0.3, 0.8],
    "digit_rate": [0.002, 0.01, 0.05, 0.1, 0.3],
    "distinct_rate": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "same_as_last": [0.005, 0.02, 0.05, 0.1, 0.3, 0.6],
    "mean_word": [2, 3, 4, 5, 6, 8, 12],
    "dup_line_rate": [0.01, 0.05, 0.1, 0.2, 0.5],
    "short_line_rate": [0.1, 0.3, 0.5, 0.8],
    "pair_repeat": [0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8],
}
OFFSETS = np.cumsum([BUCKETS, *(len(c) + 1 for c in STRUCTURE.values())])
FEATURES = int(OFFSETS[-1])
#: Structure counts for as much as all words together.
WORD_WEIGHT, BIN_VALUE = 1.0, 0.5

SYMBOLS, UPPER, MARKS, DIGITS = (re.compile(x) for x in (r"[#*$%&|<>]", r"[A-Z]", r"[!?]", r"[0-9]"))


def structure(text: str, words: list[bytes]) -> list[float]:
    n, lines = max(len(words), 1), [x for x in text.split("\n") if x and not x.isspace()]
    chars, n_lines = sum(map(len, words)), max(len(lines), 1)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(len(words)), math.log1p(len(text)), len(SYMBOLS.findall(text)) / n, len(UPPER.findall(text)) / max(chars, 1),
        len(MARKS.findall(text)) / n, len(DIGITS.findall(text)) / max(chars, 1), len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, chars / n, (len(lines) - len(set(lines))) / n_lines,
        sum(len(x) < 20 for x in lines) / n_lines, 1 - pairs / max(len(words) - 1, 1),
    ]


class WordBuckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = at = xxhash.xxh32_intdigest(word) % BUCKETS
        return at


def encode(text: str | None, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of a whole text: its hashed words by frequency, and the bin of each statistic."""
    text = text or ""
    words = text.encode("utf-8").lower().split()
    raw = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    index, count = np.unique(raw, return_counts=True)
    value = np.log1p(count)
    norm = math.sqrt(float(value @ value)) or 1.0
    bins = [int(OFFSETS[k]) + int(np.searchsorted(cuts, v, "right")) for k, (cuts, v) in enumerate(zip(STRUCTURE.values(), structure(text, text.encode("utf-8").split()), strict=True))]
    return np.concatenate([index, bins]), np.concatenate([WORD_WEIGHT * value / norm, np.full(len(bins), BIN_VALUE)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        total = vx.sum(0)
        return self.bias + float(self.linear[index] @ value) + 0.5 * float(total @ total - (vx * vx).sum())

    def score(self, text: str | None, buckets: WordBuckets) -> float:
        return 1 / (1 + math.exp(-min(max(self.margin(*encode(text, buckets)), -30), 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, epochs: int = 8, rate: float = 0.15, l2: float = 1e-5, batch: int = 64, seed: int = 5) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in mini-batches of flat arrays."""
    rng = np.random.default_rng(seed)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    fm = FactorisationMachine(math.log(mean / (1 - mean)), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
    g_linear, g_factors, g_bias = np.full(FEATURES, 1e-2), np.full((FEATURES, RANK), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            index, value = (np.concatenate([rows[r][c] for r in part]) for c in (0, 1))
            sizes = np.array([len(rows[r][0]) for r in part])
            starts, owner = np.concatenate([[0], sizes.cumsum()[:-1]]), np.repeat(np.arange(len(part)), sizes)
            v = fm.factors[index]
            vx = v * value[:, None]
            total = np.add.reduceat(vx, starts)
            margin = fm.bias + np.add.reduceat(fm.linear[index] * value, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part) * 8
            at, place = np.unique(index, return_inverse=True)
            scaled = error[owner] * value
            d_linear = np.bincount(place, scaled, len(at)) + l2 * fm.linear[at]
            d_v = scaled[:, None] * (total[owner] - vx)
            d_factors = np.stack([np.bincount(place, d_v[:, f], len(at)) for f in range(RANK)], 1) + l2 * fm.factors[at]
            g_linear[at] += d_linear**2
            g_factors[at] += d_factors**2
            fm.linear[at] -= rate * d_linear / np.sqrt(g_linear[at])
            fm.factors[at] -= 0.3 * rate * d_factors / np.sqrt(g_factors[at])
            d_bias = error.sum()
            g_bias += d_bias**2
            fm.bias -= 0.3 * rate * d_bias / math.sqrt(g_bias)
    return fm


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> FactorisationMachine:
    """A machine from at most sample_rows labelled rows whose fold is not held, picked by the hash of their ids.

    Texts are encoded on the executors; the driver gets hashed features only. Without labels every text scores
    one half. Labels without an id, a label or a document are left out; null and empty texts count as texts without
    words; of repeated rows each counts.
    """
    taught = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held))
    picked = taught.select(F.col(id_col).alias("__fm_id"), F.col(label_col).cast("int").alias("__fm_label"))
    picked = picked.orderBy(stable_order("__fm_id", "quality"), "__fm_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__fm_key"), F.col(text_col).alias("__fm_text")).join(small(picked, sample_rows), F.col("__fm_key") == F.col("__fm_id"))

    def run(batches):
        import pyarrow as pa

        buckets = WordBuckets()
        for batch in batches:
            out = []
            for text, i, label in cells([batch], "text", "id", "label"):
                index, value = encode(text, buckets)
                out.append((i, label, index.astype("<u4").tobytes(), value.astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["id", "label", "index", "value"])

    sample = rows.select(F.col("__fm_text").alias("text"), F.col("__fm_id").cast("string").alias("id"), F.col("__fm_label").alias("label"))
    got = sorted(mapped(sample, run, "id string, label long, index binary, value binary").collect(), key=tuple)
    if not got:
        return FactorisationMachine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, RANK)))
    encoded = [(np.frombuffer(r["index"], "<u4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in got]
    return train(encoded, np.array([r["label"] > 0 for r in got], float))


def score_quality(docs: DataFrame, model: FactorisationMachine, *, folds: int = 3, held: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted for each row of docs.

    Every row is scored alone from its whole text; labels, language, source and id are no inputs. Null and empty
    texts score as a text without words; repeated rows score alike; a null id is in the fold of the empty text.
    Other columns are ignored. An empty table gives an empty one.
    """
    rows = spread(docs.select(id_col, text_col)).select(id_col, (fold(id_col, folds) == held).alias("held_out"), text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        buckets = WordBuckets()
        for batch in batches:
            scores = [model.score(text, buckets) for (text,) in cells([batch], text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(scores, pa.float64())], [f.name for f in schema])

    return mapped(rows, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
