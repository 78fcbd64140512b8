"""Evaluation: classification, ranking, clustering, language model, summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.operators.order import running


def confusion(df: DataFrame, truth: str, predicted: str, *, classes=config.RISKS, default: str = "low") -> DataFrame:
    """(truth, <class>...): counts of predictions for each true class; null predictions count as default."""
    rows = df.where(F.col(truth).isNotNull()).select(F.col(truth).alias("truth"), F.coalesce(predicted, F.lit(default)).alias("p"))
    counts = [F.count_if(F.col("p") == c).alias(c) for c in classes]
    return rows.groupBy("truth").agg(*counts)


def class_f1(df: DataFrame, truth: str, predicted: str, *, keys: list[str] | None = None, default: str = "low", classes=config.RISKS, least_rows: int = 1) -> DataFrame:
    """(keys, label, n_true, n_predicted, n_both, precision, recall, f1); a ratio over nothing is 0."""
    keys = keys or []
    rows = df.where(F.col(truth).isNotNull()).select(*keys, F.col(truth).alias("t"), F.coalesce(predicted, F.lit(default)).alias("p"))
    cells = rows.groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select(*keys, "n", F.explode(F.array(*map(F.lit, classes))).alias("label"), "t", "p")
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    t, p = F.col("t") == F.col("label"), F.col("p") == F.col("label")
    out = each.groupBy(*keys, "label").agg(s(t).alias("n_true"), s(p).alias("n_predicted"), s(t & p).alias("n_both"), F.sum("n").alias("__n")).where(F.col("__n") >= least_rows).drop("__n")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return out.withColumns({"precision": ratio("n_both", F.col("n_predicted")), "recall": ratio("n_both", F.col("n_true")), "f1": F.coalesce(2 * F.col("n_both") / F.nullif(F.col("n_true") + F.col("n_predicted"), F.lit(0)), F.lit(0.0))})


def macro_f1(per_class: DataFrame, *, keys: list[str] | None = None, present_only: bool = True) -> DataFrame:
    """(keys, macro_f1): the mean over the labels that occur as truth or prediction, or over all."""
    rows = per_class.where((F.col("n_true") + F.col("n_predicted")) > 0) if present_only else per_class
    return rows.groupBy(*(keys or [])).agg(F.avg("f1").alias("macro_f1"))


def accuracy(df: DataFrame, truth: str, predicted: str, *, default: str = "low") -> DataFrame:
    rows = df.where(F.col(truth).isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.coalesce(predicted, F.lit(default))).cast("double")).alias("accuracy"))


def score_counts(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """(keys, score, pos, neg): rows of each distinct score. What follows works on distinct scores only."""
    y = F.col(label).cast("int")
    rows = df.where(y.isNotNull() & F.col(score).isNotNull())
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_pos, n_neg, auc): the chance that a positive outranks a negative, ties half; null without both kinds."""
    keys = keys or []
    below = running(score_counts(df, label, score, keys), keys, "score", ["neg"])
    out = below.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("__u"))
    return out.withColumn("auc", F.col("__u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).drop("__u")


def roc_points(df: DataFrame, label: str, score: str, *, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, tpr, fpr) at each distinct score, by running sums from the top."""
    keys = keys or []
    counts = running(score_counts(df, label, score, keys), keys, "score", ["pos", "neg"], down=True)
    rate = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.nullif(F.col(f"all_{c}"), F.lit(0))
    return counts.select(*keys, F.col("score").alias("threshold"), rate("pos").alias("tpr"), rate("neg").alias("fpr"))


def one_vs_rest(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """(label, y, p) in long form: a row for each row and class."""
    cells = F.array(*[F.struct(F.lit(c).alias("label"), (F.col(truth) == c).cast("int").alias("y"), F.col(p).cast("double").alias("p")) for c, p in probabilities.items()])
    return df.where(F.col(truth).isNotNull()).select(F.explode(cells).alias("c")).select("c.label", "c.y", "c.p")


def rule_probabilities(score: str) -> dict[str, Column]:
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    raw = {"low": 1 - s, "medium": 1 - F.abs(s - 0.35), "high": s}
    total = raw["low"] + raw["medium"] + raw["high"]
    return {k: v / total for k, v in raw.items()}


def spread_probabilities(level: str, confidence: str, classes=config.RISKS) -> dict[str, Column]:
    """The confidence on the predicted class and the rest shared by the others."""
    c = F.coalesce(F.col(confidence).cast("double"), F.lit(0.5))
    return {k: F.when(F.coalesce(F.col(level), F.lit("low")) == k, c).otherwise((1 - c) / (len(classes) - 1)) for k in classes}


def silhouette(df: DataFrame, *, id_col: str, vector: str, cluster: str) -> DataFrame:
    """(id_col, cluster, silhouette) under cosine distance, in time linear in the rows.

    The mean distance of x to a cluster of unit vectors is 1 - x . S / n with their sum S, so rows need sums of
    clusters only, not each other. A row that is alone in its cluster has 0; rows without a cluster or a length have
    none. Tasks sum their rows by cluster, and the sums of all clusters, as many numbers as clusters times dimensions,
    go to each task, which multiplies its batches with them.
    """
    rows = df.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).select(id_col, F.col(cluster).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["c"].dataType

    def units(batch):
        m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        lengths = np.linalg.norm(m, axis=1)
        return m / np.where(lengths > 0, lengths, 1)[:, None], lengths > 0

    def summed(batches):
        import pyarrow as pa

        sums, schema = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            u, there = units(batch)
            names = batch.column("c").to_pylist()
            place = {c: k for k, c in enumerate(dict.fromkeys(names))}
            at = np.fromiter(map(place.__getitem__, names), np.int64, len(names))
            total = np.zeros((len(place), u.shape[1]))
            np.add.at(total, at[there], u[there])
            many = np.bincount(at[there], minlength=len(place))
            for c, k in place.items():
                n, s = sums.get(c, (0, 0.0))
                sums[c] = n + int(many[k]), s + total[k]
        if sums:
            values = [pa.array(list(sums), schema.field("c").type), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([s.tolist() for _, s in sums.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(values, ["c", "n", "s"])

    parts = rows.select("c", "v").mapInArrow(summed, T.StructType([T.StructField("c", kind), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))]))
    places = parts.select("c", "n", F.posexplode("s").alias("k", "x")).groupBy("c", "k").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    table = places.groupBy("c").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "s")))["s"].alias("s")).where("n > 0").collect()
    names = [r["c"] for r in table]
    bank = df.sparkSession.sparkContext.broadcast(({c: k for k, c in enumerate(names)}, np.array([r["n"] for r in table], float), np.array([r["s"] for r in table], float)))

    def scored(batches):
        import pyarrow as pa

        place, n, sums = bank.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u, there = units(batch)
            batch, u = batch.filter(pa.array(there)), u[there]
            if not len(u):
                continue
            at, row = np.fromiter(map(place.__getitem__, batch.column("c").to_pylist()), np.int64, len(u)), np.arange(len(u))
            d = u @ sums.T
            far = 1 - d / n
            a = (n[at] - d[row, at]) / np.maximum(n[at] - 1, 1)
            far[row, at] = np.inf
            b = far.min(1)
            top = np.maximum(a, b)
            s = np.where((n[at] == 1) | ~np.isfinite(b) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("c"), pa.array(np.where(np.isfinite(s), s, 0.0))], [id_col, cluster, "silhouette"])

    return rows.mapInArrow(scored, T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(cluster, kind), T.StructField("silhouette", T.DoubleType())]))


def ndcg(df: DataFrame, *, score: str, relevance: str, ks=(50, 100, 500), keys: list[str] | None = None) -> DataFrame:
    """(keys, k, ndcg): gains of equal scores are averaged, as over all their orders; discount log2(rank + 1).

    Rows collapse to distinct scores first, with their number and mean gain; a group's discounts are a sum over
    its ranks up to k. Of a key's distinct scores only the largest, as many as the largest k, are ever sorted, and each
    task sends no more than these.
    """
    keys = keys or []
    groups = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(relevance).cast("double")).alias("g"))
    ideal = df.where(F.col(score).isNotNull()).groupBy(*keys, F.col(relevance).cast("double").alias("g")).agg(F.count(F.lit(1)).alias("n"))

    def total(rows: DataFrame, order: str, name: str) -> DataFrame:
        by = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc(order))
        rows = rows.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= max(ks))
        w = by.rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("a", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("a < k")
        ranks = F.sequence(F.col("a") + 1, F.least(F.col("a") + F.col("n"), F.col("k").cast("long")))
        discount = F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1))
        return placed.groupBy(*keys, "k").agg(F.sum(F.col("g") * discount).alias(name))

    both = total(groups, "s", "dcg").join(total(ideal, "g", "idcg"), [*keys, "k"])
    return both.select(*keys, "k", F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def tokens(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def bigrams(texts: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """(id_col, place, prev, w): each word with the one before it, <s> before the first."""
    rows = texts.select(id_col, tokens(text).alias("t"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit("<s>")), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0)))).alias("prev"), F.col("t").alias("w"))
    out = rows.where(F.size("t") > 0).select(id_col, F.posexplode(pairs).alias("place", "b"))
    return out.select(id_col, "place", F.col("b.prev").alias("prev"), F.col("b.w").alias("w"))


def perplexity(train: DataFrame, test: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """(id_col, n, perplexity) of test texts under an add-one bigram model of train; words and pairs join by equality,
    and unknown ones count 0. Texts without words have no row."""
    pairs = bigrams(train, id_col=id_col, text=text)
    two = pairs.groupBy("prev", "w").agg(F.count(F.lit(1)).alias("c2"))
    one = pairs.groupBy("prev").agg(F.count(F.lit(1)).alias("c1"))
    # As in counting words one by one: a context counts as often as it is a word; <s> as often as a text starts.
    words = pairs.groupBy(F.col("w").alias("prev")).agg(F.count(F.lit(1)).alias("c1")).unionByName(one.where("prev = '<s>'"))
    size = pairs.agg(F.count_distinct("w").alias("v"))
    asked = bigrams(test, id_col=id_col, text=text)
    met = asked.join(two, ["prev", "w"], "left").join(words, "prev", "left").crossJoin(F.broadcast(size))
    p = (F.coalesce("c2", F.lit(0)) + 1) / (F.coalesce("c1", F.lit(0)) + F.col("v"))
    return met.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.exp(-F.avg(F.ln(p))).alias("perplexity"))


def stratified_sample(df: DataFrame, *, label: str, key: str, n: int, seed: str = "test") -> DataFrame:
    """About n rows with each label's share, the first of each by the md5 of seed and key; n is the feature.

    No label takes more than n, and with that bound on the rank each task sends at most n rows of a label.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    w, all_rows = Window.partitionBy(label), Window.partitionBy(F.lit(0))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    wanted = sizes.withColumn("__take", F.round(F.lit(n) * F.col("__n") / F.sum("__n").over(all_rows)).cast("long")).select(F.col(label).alias("__l"), "__take")
    ranked = df.withColumn("__k", F.row_number().over(w.orderBy(order, key))).where(F.col("__k") <= n)
    return ranked.join(F.broadcast(wanted), F.col(label).eqNullSafe(F.col("__l"))).where(F.col("__k") <= F.col("__take")).drop("__k", "__l", "__take")


def method_summary(df: DataFrame, methods: dict[str, str], truth: str | None = None) -> DataFrame:
    """(method, n, pct_high, pct_medium, pct_low, accuracy): one row a method, from one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("p")) for m, c in methods.items()])
    long = df.select(*([truth] if truth else []), F.explode(cells).alias("m")).where(F.col("m.p").isNotNull())
    pct = lambda level: (100 * F.avg((F.col("m.p") == level).cast("double"))).alias(f"pct_{level}")
    right = [F.avg((F.col("m.p") == F.col(truth)).cast("double")).alias("accuracy")] if truth else []
    return long.groupBy(F.col("m.method").alias("method")).agg(F.count(F.lit(1)).alias("n"), *map(pct, ("high", "medium", "low")), *right)
