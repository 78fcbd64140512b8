"""Exact nearest neighbours of many posts among labelled seeds, and scores built on them.

The seeds are the small side. If their measured bytes are few, they travel as one matrix and each task multiplies its
batches with it; there is no join and no shuffle. If they are many, posts are dealt into chunks that fit in a task;
the seeds, cut into blocks, stream past each chunk, which keeps its nearest so far. Nothing is gathered on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of seeds that are sent to tasks as one matrix, and of the posts of a chunk. Seeds of a block.
MATRIX_BYTES, CHUNK_BYTES, BLOCK = 16 << 20, 32 << 20, 2048
#: Similarities that a task has in memory at once.
CELLS = 1 << 22


def seed_bank(posts: DataFrame, *, label: str, order: str, tie: str, n: int) -> DataFrame:
    """The first n rows of each label by order, descending; ties by the key tie."""
    w = Window.partitionBy(label).orderBy(F.desc(order), tie)
    return posts.where(F.col(label).isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def _units(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def _matrix(vectors) -> np.ndarray:
    """The unit vectors of an Arrow list column, without a Python object a number."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return _units(flat.reshape(len(vectors), -1)) if len(vectors) else np.empty((0, 0))


def _nearest(posts: np.ndarray, seed_ids: np.ndarray, labels: np.ndarray, seeds: np.ndarray, k: int, per_label: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of posts, seed's place, similarity) of each post's k nearest, over all seeds or for each label."""
    groups = [np.flatnonzero(labels == x) for x in np.unique(labels)] if per_label else [np.arange(len(seed_ids))]
    rows, picked, found = [], [], []
    step = max(1, CELLS // max(len(seed_ids), 1))
    for start in range(0, len(posts), step):
        sims = np.round(posts[start : start + step] @ seeds.T, 9)
        for g in groups:
            x = sims[:, g]
            least = np.partition(x, len(g) - k, axis=1)[:, len(g) - k, None] if len(g) > k else -np.inf
            r, c = np.nonzero(x >= least)
            keep = _first(r, -x[r, c], seed_ids[g[c]], k)
            rows.append(r[keep] + start), picked.append(g[c[keep]]), found.append(x[r[keep], c[keep]])
    return np.concatenate(rows), np.concatenate(picked), np.concatenate(found)


def _first(group: np.ndarray, order: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each group by order, ties by tie."""
    at = np.lexsort((tie, order, group))
    sorted_ = group[at]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(at) else np.empty(0, bool)
    starts = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[np.arange(len(at)) - starts < k]


def neighbours(posts: DataFrame, seeds: DataFrame, *, id_col: str, vector: str, seed_id: str = "seed_id", seed_label: str = "label", seed_vector: str = "embedding", k: int = 10, per_label: bool = False, matrix_bytes: int | None = None) -> DataFrame:
    """(id_col, seed_id, label, similarity, rank): each post's k nearest seeds by cosine, over all or for each label.

    Ties are broken by seed id. Posts without a vector have no row. Similarities are rounded to 9 places before
    they are ranked, so that the order of summation cannot decide. Seeds of more than matrix_bytes go in blocks.
    """
    spark = posts.sparkSession
    s = seeds.select(F.col(seed_id).cast("long").alias("i"), F.coalesce(F.col(seed_label).cast("string"), F.lit("")).alias("l"), F.col(seed_vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    p = posts.select(id_col, F.col(vector).cast("array<double>").alias("__v")).where("__v IS NOT NULL")
    schema = T.StructType([T.StructField(id_col, posts.schema[id_col].dataType), T.StructField("seed_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("similarity", T.DoubleType())])
    n, size = s.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if 8 * n * size <= (MATRIX_BYTES if matrix_bytes is None else matrix_bytes):
        hits = _by_matrix(p, s, schema, k, per_label)
    else:
        hits = _by_chunks(p, s, schema, k, per_label, size, n)
    w = Window.partitionBy(id_col, *(["label"] if per_label else [])).orderBy(F.desc("similarity"), "seed_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _by_matrix(p: DataFrame, s: DataFrame, schema: T.StructType, k: int, per_label: bool) -> DataFrame:
    found = s.orderBy("i").collect()
    bank = p.sparkSession.sparkContext.broadcast((np.array([r["i"] for r in found]), np.array([r["l"] for r in found], object).astype(str), _units(np.array([r["v"] for r in found], float))))

    def run(batches):
        import pyarrow as pa

        seed_ids, labels, matrix = bank.value
        for batch in batches:
            rows, picked, sims = _nearest(_matrix(batch.column("__v")), seed_ids, labels, matrix, k, per_label)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(seed_ids[picked]), pa.array(labels[picked].tolist(), pa.string()), pa.array(sims)], schema.names)

    return p.mapInArrow(run, schema)


def _by_chunks(p: DataFrame, s: DataFrame, schema: T.StructType, k: int, per_label: bool, size: int, n: int) -> DataFrame:
    id_col = schema.names[0]
    chunks = max(1, -(-p.count() * 8 * size // CHUNK_BYTES))
    packed = s.groupBy(F.pmod(F.xxhash64("i"), F.lit(-(-n // BLOCK))).alias("__b")).agg(F.collect_list(F.struct("i", "l", "v")).alias("__s"))
    nothing = F.lit(None)
    asked = p.select(F.pmod(F.xxhash64(id_col), F.lit(chunks)).alias("__c"), F.lit(0).alias("__role"), id_col, "__v", nothing.cast("array<struct<i:bigint,l:string,v:array<double>>>").alias("__s"))
    banks = packed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("__c"), F.lit(1).alias("__role"), nothing.cast(p.schema[id_col].dataType).alias(id_col), nothing.cast("array<double>").alias("__v"), "__s")
    rows = asked.unionByName(banks).repartition("__c").sortWithinPartitions("__c", "__role")

    def run(batches):
        import pyarrow as pa

        here, ids, held, posts, best, size_ = None, [], [], None, [], 0

        def compact():
            rows_, seeds_, sims_, labels_ = (np.concatenate(x) for x in zip(*best, strict=True))
            group = rows_ * 1_000_003 + np.unique(labels_, return_inverse=True)[1] if per_label else rows_
            keep = _first(group, -sims_, seeds_, k)
            return [(rows_[keep], seeds_[keep], sims_[keep], labels_[keep])]

        def emitted():
            if best:
                rows_, seeds_, sims_, labels_ = compact()[0]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(rows_)), pa.array(seeds_), pa.array(labels_.tolist(), pa.string()), pa.array(sims_)], schema.names)

        for batch in batches:
            chunk, role = batch.column("__c").to_numpy(), batch.column("__role").to_numpy()
            for start in np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])]) if len(chunk) else []:
                stop = start + int(np.flatnonzero(np.r_[(chunk[start + 1 :] != chunk[start]) | (role[start + 1 :] != role[start]), True])[0]) + 1
                part = batch.slice(int(start), int(stop - start))
                if chunk[start] != here:
                    yield from emitted()
                    here, ids, held, posts, best, size_ = chunk[start], [], [], None, [], 0
                if not role[start]:
                    ids.append(part.column(id_col))
                    held.append(_matrix(part.column("__v")))
                    continue
                if not held:
                    continue
                if posts is None:
                    posts = np.concatenate(held)
                for r in range(part.num_rows):
                    bank = part.column("__s").slice(r, 1).flatten()
                    seed_ids, labels = bank.field("i").to_numpy(), np.array(bank.field("l").to_pylist(), object).astype(str)
                    got, picked, sims = _nearest(posts, seed_ids, labels, _matrix(bank.field("v")), k, per_label)
                    best.append((got, seed_ids[picked], sims, labels[picked]))
                    size_ += len(got)
                    if size_ > CELLS:
                        best = compact()
                        size_ = len(best[0][0])
        yield from emitted()

    return rows.mapInArrow(run, schema)


def classify_by_neighbours(posts: DataFrame, seeds: DataFrame, *, id_col: str, vector: str, k: int = 10, mode: str = "per_class", classes=("high", "medium", "low"), review_below: float = 0.15, **names) -> DataFrame:
    """(id_col, risk_level, confidence, prob_<class>, needs_review).

    per_class: a class scores the mean of its own k nearest seeds. global: the mean of its seeds among the k
    nearest of all, 0 if none. Scores are shifted to be no lower than 0 and normalised; confidence is the margin
    between the two best, and equal scores go to the earlier class.
    """
    hits = neighbours(posts, seeds, id_col=id_col, vector=vector, k=k, per_label=mode == "per_class", **names)
    means = [F.greatest(F.coalesce(F.avg(F.when(F.col("label") == c, F.col("similarity"))), F.lit(0.0)), F.lit(0.0)).alias(f"__{c}") for c in classes]
    raw = hits.groupBy(id_col).agg(*means)
    total = sum((F.col(f"__{c}") for c in classes), F.lit(0.0))
    out = raw.select(id_col, *[F.when(total > 0, F.col(f"__{c}") / total).otherwise(F.lit(1.0 / len(classes))).alias(f"prob_{c}") for c in classes])
    ranked = F.array_sort(F.array(*[F.struct((-F.round(f"prob_{c}", 9)).alias("p"), F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in enumerate(classes)]))
    out = out.withColumn("__r", ranked)
    out = out.withColumns({"risk_level": F.col("__r")[0]["c"], "confidence": F.round(F.col("__r")[1]["p"] - F.col("__r")[0]["p"], 9)})
    return out.withColumn("needs_review", F.col("confidence") < review_below).drop("__r")


def retrieve(query: list[float], posts: DataFrame, *, id_col: str, vector: str, k: int = 5, where=None) -> DataFrame:
    """The k posts most similar to one query vector (TakeOrderedAndProject), of those that pass where."""
    from tidemark.functions.vectors import cosine

    rows = posts if where is None else posts.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("similarity", F.round(cosine(vector, q), 9)).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), id_col).limit(k)


def rerank(candidates: DataFrame, scorer=None, *, keys: list[str], id_col: str, k: int = 10) -> DataFrame:
    """The k best candidates of each key, by a scorer (a column function) or, without one, by similarity."""
    score = scorer(candidates) if scorer else F.col("similarity")
    w = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), id_col)
    return candidates.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_label_score(posts: DataFrame, seeds: DataFrame, *, id_col: str, vector: str, k: int = 5, **names) -> DataFrame:
    """(id_col, label, score): over the labels, the largest mean of a post's k nearest seeds of that label."""
    hits = neighbours(posts, seeds, id_col=id_col, vector=vector, k=k, per_label=True, **names)
    means = hits.groupBy(id_col, "label").agg(F.round(F.avg("similarity"), 9).alias("score"))
    best = means.groupBy(id_col).agg(F.max(F.struct("score", "label")).alias("b"))
    return best.select(id_col, "b.label", "b.score")


def neighbours_in_groups(posts: DataFrame, queries: DataFrame, *, keys: list[str], id_col: str, vector: str, query_vector: str = "query_vector", k: int = 30) -> DataFrame:
    """posts (with keys) that are among the k nearest to their group's query vector, with similarity and rank.

    A group's posts are ranked in a window that keeps k of them, and Spark cuts to k on the map side first.
    """
    from tidemark.functions.vectors import cosine

    joined = posts.join(queries.select(*keys, query_vector), keys)
    scored = joined.withColumn("similarity", F.round(cosine(vector, query_vector), 9)).drop(query_vector).where("similarity IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy(F.desc("similarity"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
