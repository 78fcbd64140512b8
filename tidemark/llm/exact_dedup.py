"""Exact deduplication by 128-bit content hash.

Rows are grouped by the hash alone, so the shuffle carries hashes and ids but no texts, and copies collapse on
the map side. Only in groups of two or more rows are bytes compared: a second aggregate has (hash, text) as its
key, whose hash map compares key bytes; copies collapse on the map side there too, so a group of any size sends
one row a task. Hashes that turn out to hold different texts are then grouped by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small, text_or_empty

HASH, ID, TEXT = "__dup_hash", "__dup_id", "__dup_text"


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


KEEP, SIZE, KEPT, ROWS = "__dup_keep", "__dup_size", "__dup_kept", "__dup_rows"


def _groups(rows: DataFrame, *keys: str, keep: str) -> DataFrame:
    """(keys, KEEP, SIZE, ROWS): the id that stays, all rows, and rows that have that id."""
    by_id = rows.groupBy(*keys, ID).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(ID, "n")) if keep == "largest" else F.min(F.struct(F.col(ID).isNull(), ID, "n"))
    out = by_id.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias(SIZE))
    return out.select(*keys, F.col(f"best.{ID}").alias(KEEP), SIZE, F.col("best.n").alias(ROWS))


def _marked(docs: DataFrame, *, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """docs with KEEP, SIZE, KEPT, ROWS and HASH."""
    text = text_or_empty(text_col)
    rows = docs.select(hash_of(text).alias(HASH), F.col(id_col).alias(ID))
    groups = checkpointed(_groups(rows, HASH, keep=keep).where(F.col(SIZE) > 1))
    texts = docs.select(hash_of(text).alias(HASH), text.alias(TEXT)).join(small(groups.select(HASH)), HASH, "left_semi")
    collided = checkpointed(texts.groupBy(HASH, TEXT).count().groupBy(HASH).count().where("count > 1").select(HASH))

    hashed = docs.withColumn(HASH, hash_of(text))
    if collided.isEmpty():
        return _joined(hashed, small(groups), [HASH], id_col)
    collided = small(collided)
    clean = _joined(hashed.join(collided, HASH, "left_anti"), small(groups), [HASH], id_col)
    mixed = hashed.join(collided, HASH, "left_semi").withColumn(TEXT, text)
    by_text = _groups(mixed.select(HASH, TEXT, F.col(id_col).alias(ID)), HASH, TEXT, keep=keep)
    return clean.unionByName(_joined(mixed, by_text, [HASH, TEXT], id_col).drop(TEXT))


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Each row with its group; a row without one is alone. groups has one row a key, so that a join by
    shuffle, taken where groups are too many to broadcast, can split the rows of a large group."""
    joined = rows.join(groups, keys, "left").withColumns(
        {
            KEEP: F.when(F.col(SIZE).isNull(), F.col(id_col)).otherwise(F.col(KEEP)),
            SIZE: F.coalesce(SIZE, F.lit(1)).cast("long"),
            ROWS: F.coalesce(ROWS, F.lit(1)).cast("long"),
        }
    )
    return joined.withColumn(KEPT, F.col(id_col).eqNullSafe(F.col(KEEP)))


def duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """docs with the columns keep_id, group_size and kept.

    Options: keep ("largest" or "smallest" id), id_col, text_col, and hash_of, which is there so that tests can make
    hashes collide. Null texts count as empty. A null id is below all others and stays only where a group has no
    other. Repeated rows (same id and text) are all marked kept; drop_duplicates() leaves one of them. An empty table
    gives an empty one. Columns of docs with the three names are replaced.
    """
    named = {"keep_id": KEEP, "group_size": SIZE, "kept": KEPT}
    return _marked(docs, **options).select(*[c for c in docs.columns if c not in named], *[F.col(inner).alias(c) for c, inner in named.items()])


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one for each distinct text, with exactly the columns of docs."""
    stay = _marked(docs, **options).where(KEPT)
    once = stay.where(F.col(ROWS) == 1).select(*docs.columns)
    repeated = stay.where(F.col(ROWS) > 1)
    if repeated.isEmpty():
        return once
    return once.unionByName(repeated.dropDuplicates([HASH, KEEP]).select(*docs.columns))
