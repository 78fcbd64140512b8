"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the runs of one to four characters within its words, a mark at either end of a word being
one of them; each is hashed to a row of an embedding table. A text is the mean of its subwords' rows, and a linear layer with softmax gives the languages. Table and
layer are trained together by stochastic gradient descent in numpy. The score is calibrated by a temperature, and
texts that score below a threshold, fitted so that few training texts fall under it, are marked rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cells, fold, mapped, spread, stable_order
from tidemark.llm.packing import chunks

#: Labelled texts to learn from; of each, all words are read.
SAMPLE_ROWS = 6_000
#: Rows of each language drawn beyond its share, so that a small share isn't missed by chance.
SPARE_ROWS = 64
BUCKETS, DIMENSIONS = 1 << 15, 16
Bag = tuple[np.ndarray, np.ndarray]

NO_LETTERS = re.compile(r"[\W\d_]+")
U = np.uint64


def subwords(text: str) -> np.ndarray:
    """The buckets of a text's subwords, hashed for all places at once; none if it has no letter."""
    spaced = f" {NO_LETTERS.sub(' ', text.lower()).strip()} "
    if len(spaced) < 3:
        return np.empty(0, np.int64)
    c = np.frombuffer(spaced.encode("utf-32-le"), np.uint32).astype(U)
    inside = c != 32
    out, h, valid = [c[inside]], c, np.ones(len(c), bool)
    for n in (2, 3, 4):  # a run may have a mark at its ends only
        h = h[:-1] * U(0x9E3779B97F4A7C15) + c[n - 1 :]
        valid = valid[:-1] & inside[n - 2 : len(c) - 1] if n > 2 else valid[:-1]
        out.append(h[valid] + U(n))
    x = np.concatenate(out) * U(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> U(29))) * U(0x94D049BB133111EB) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (sums / np.maximum(counts, 1)[:, None]) @ self.layer + self.bias


def counted(text: str | None) -> np.ndarray:
    """How often each bucket occurs among a whole text's subwords."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in chunks(text or ""):
        counts += np.bincount(subwords(part), minlength=BUCKETS)
    return counts


def summed(text: str | None, model: LanguageModel) -> tuple[np.ndarray, int]:
    """The sum of the rows of a whole text's subwords, and their number."""
    counts = counted(text)
    return counts @ model.table, int(counts.sum())


def bag(text: str | None) -> Bag:
    """A whole text's distinct subwords, and how often each occurs: six bytes a distinct subword."""
    counts = counted(text)
    index = np.flatnonzero(counts)
    return index.astype("<u2"), counts[index].astype("<u4")


def train(texts: list[str | Bag], targets: np.ndarray, languages: list[str], *, epochs: int = 4, rate: float = 4.0, batch: int = 32, seed: int = 3) -> LanguageModel:
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages)))
    bags = [bag(t) if isinstance(t, str) else t for t in texts]
    shares = lambda r: bags[r][1] / max(bags[r][1].sum(), 1)  # noqa: E731  (of a text's mean, by its distinct subwords)
    known = np.array([k for k, (b, _) in enumerate(bags) if len(b)], np.int64)
    held = known[rng.random(len(known)) < 0.2]
    taught = np.setdiff1d(known, held) if len(held) < len(known) else known
    epochs = max(epochs, min(60, 24_000 // max(len(taught), 1)))  # few texts are seen more often
    steps, done = max(epochs * len(taught), 1), 0
    for _ in range(epochs):
        order = rng.permutation(taught)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            flat, share = np.concatenate([bags[r][0] for r in rows]), np.concatenate([shares(r) for r in rows])
            sizes = np.array([len(bags[r][0]) for r in rows])
            starts = np.concatenate([[0], sizes.cumsum()[:-1]])
            mean = np.add.reduceat(model.table[flat] * share[:, None], starts)
            p = softmax(mean @ model.layer + model.bias)
            p[np.arange(len(rows)), targets[rows]] -= 1
            step = rate * (1 - done / steps) / len(rows)
            back = p @ model.layer.T
            model.layer -= step * mean.T @ p
            model.bias -= step * p.sum(0)
            index, place = np.unique(flat, return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), sizes)
            total = np.stack([np.bincount(place, back[owner, d] * share, len(index)) for d in range(DIMENSIONS)], 1)
            model.table[index] -= step * total
            done += len(rows)
    if len(held):
        z = np.stack([shares(r) @ model.table[bags[r][0]] @ model.layer + model.bias for r in held])
        grid = np.geomspace(0.2, 5, 41)
        loss = [-np.log(softmax(z / t)[np.arange(len(held)), targets[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        model.least = float(min(np.quantile(softmax(z / model.temperature).max(1), 0.005), 0.9))
    return model


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_languages(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, most_languages: int | None = None, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from about sample_rows texts with a known language whose fold is not held; None if there are none.

    The sample takes equally many texts of each language, or all where it has fewer, picked by the hash of their ids:
    the ids of each language are counted first, and each has its own bound, whatever the size of the table and of the
    others. With more languages than sample_rows each has one text. All languages are learned, or the most_languages most
    common ones if that is given. Whole texts are counted on the executors, in training as in prediction; the driver gets
    the languages and the hashed counts of the sample only. Rows with a null language or id are left out; null and empty
    texts, and those without a letter, take a place in the sample but teach nothing. Of repeated rows each may be taken.
    """
    taught = docs.where(F.col(lang_col).isNotNull() & (fold(id_col, folds) != held) & F.col(id_col).isNotNull())
    taught = taught.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    common = taught.groupBy("l").agg(F.count(F.lit(1)).alias("c"), F.approx_count_distinct("i").alias("n")).orderBy(F.desc("c"), "l")
    counts = {r["l"]: r["n"] for r in (common if most_languages is None else common.limit(most_languages)).collect()}
    if not counts:
        return None
    share = sample_rows // len(counts) + 1
    # An even draw by hash that yields a little more than the share of each language, so that little is sorted; then the bound itself.
    ratios = docs.sparkSession.createDataFrame([(l, (1.3 * share + SPARE_ROWS) / n) for l, n in counts.items()], "l string, ratio double")
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col("i")), F.lit(1 << 30)).cast("double") / float(1 << 30)
    rows = spread(taught.join(F.broadcast(ratios), "l").where(drawn < F.col("ratio")).select(stable_order("i", "sample").alias("o"), "l", "t"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for order, l, text in cells([batch], "o", "l", "t"):
                index, count = bag(text)
                yield pa.RecordBatch.from_arrays([pa.array([order], pa.int64()), pa.array([l], pa.string()), pa.array([index.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["o", "l", "index", "count"])

    bags = mapped(rows, run, "o long, l string, index binary, count binary")
    place = F.row_number().over(Window.partitionBy("l").orderBy("o", "index", "count"))
    sample = sorted(bags.withColumn("k", place).where(F.col("k") <= share).drop("o").collect(), key=lambda r: (r["k"], r["l"]))
    languages = sorted(counts)
    at = {l: k for k, l in enumerate(languages)}
    return train([(np.frombuffer(r["index"], "<u2"), np.frombuffer(r["count"], "<u4")) for r in sample], np.array([at[r["l"]] for r in sample], np.int64), languages)


def identify_languages(docs: DataFrame, model: LanguageModel | None, *, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score and rejected for each row of docs.

    A text without a letter, or null, is "und" with score 0 and rejected. All others get a learned language, and
    rejected is true where the calibrated score is below the model's threshold. Language, source and id are no
    inputs. Repeated rows get equal results. Other columns are ignored. An empty table gives an empty one.
    Without a model every text is "und".
    """
    rows = spread(docs.select(id_col, text_col)).select(id_col, (fold(id_col, folds) == held).alias("held_out"), text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sums, counts = [], []
            for (text,) in cells([batch], text_col):
                total, n = summed(text, model) if model else (0.0, 0)
                sums.append(np.broadcast_to(total, DIMENSIONS)), counts.append(n)
            counts = np.array(counts, np.int64)
            known = counts > 0
            names, score = np.full(len(counts), "und", object), np.zeros(len(counts))
            if known.any():
                p = softmax(model.logits(np.array(sums)[known], counts[known]) / model.temperature)
                names[known], score[known] = np.array(model.languages, object)[p.argmax(1)], p.max(1)
            rejected = ~known | (score < (model.least if model else 1))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rejected)], [f.name for f in schema])

    return mapped(rows, run, schema)
