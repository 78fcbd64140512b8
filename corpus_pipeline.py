"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of documents, further columns of docs included, whatever their names. run() applies them in order and
writes each result once, to the shared folder; a caller that writes each stage's result and reads it again as the
next one's docs gets the same rows. An empty table passes all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import deleted, labels, written
from tidemark.llm.exact_dedup import drop_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_json
from tidemark.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model, fitted on the labelled ones among them, rejects.

    Null and empty texts score as texts without words; repeated rows stay or go together; without labels of both kinds
    the model's prior decides for all.
    """
    return drop_toxic(docs, fit_toxicity(docs, labels(spark, sf_dir)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: the row of the largest id, and of repeated rows one. Null texts count as empty;
    a row without an id stays only where its text has no other."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of five-word shingles at a similarity of 0.8 connect: that of the
    smallest id. Texts without words are linked with nothing and stay, as do rows without an id whose set is theirs alone."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target shares. A null source is one of its own;
    a text without words has no size and is repeated at its source's rate like the others; repeated rows draw alike."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most 4096 tokens. A null or empty text is
    the end token alone; copies are packed each."""
    return pack_documents(docs, tokenizer_json())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A model's scores, near-duplicate groups and token ids are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of documents after all stages.

    Each stage but the last is written once, so that none is computed again for the jobs of those that follow, and a
    lost executor costs one stage at most; a result is deleted when the next one is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
