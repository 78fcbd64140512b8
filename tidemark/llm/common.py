"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space and the control characters tab to carriage return.
#: ``bytes.split()`` cuts at exactly these six bytes, so UTF-8 bytes give the same words.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of more bytes than this is never broadcast; nor is a sample whose documented bound is more rows than that.
BROADCAST_BYTES, BROADCAST_ROWS = 24 << 20, 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the one that the cluster names.

    Only a session on one machine (a local master) that names none gets a temporary folder; elsewhere it is an error,
    for executors could not read what others wrote there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder as Parquet and read again, and its path: for tables with long texts, of which
    what follows reads some columns, more than once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of checkpointed frames. Call it when all that was made of them is checkpointed itself."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            deleted(df.sparkSession, file.get())


def bytes_of(df: DataFrame) -> int:
    """The bytes of a checkpointed table, or more than those of a part of one, by its files; of any other table
    about its bytes, by a job: its strings and binaries as measured, 16 for each other cell."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    if plan.nodeName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()
    wide = [F.sum(F.octet_length(f.name)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    rows, *sums = df.agg(F.count(F.lit(1)), *wide).first()
    return 16 * rows * len(df.columns) + sum(x or 0 for x in sums)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is proven small; else as it is, to be joined by shuffle.

    A bounded sample passes its greatest number of rows. All other tables are measured, so they ought to be
    checkpointed ones.
    """
    fits = bytes_of(df) <= BROADCAST_BYTES if rows is None else rows <= BROADCAST_ROWS
    return F.broadcast(df) if fits else df


#: Bytes of an Arrow batch that goes to Python: two workers an executor hold a few of these each.
ARROW_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """Gets a table ready for Python: bounds its batches by bytes, and deals one of fewer partitions than cores
    over all cores; larger tables stay as they are.

    The bound is a setting of the session, which plans read when they run, so it stays set; one that the session
    has set lower itself is left alone.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def stable_order(id_col: str, seed: str) -> Column:
    """A pseudo-random but repeatable order of rows, for bounded samples."""
    return F.xxhash64(F.lit(seed), F.col(id_col))


def cells(batches, *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches one by one, so that a batch's texts are never all Python strings at once."""
    for batch in batches:
        picked = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in picked)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with workers that give freed memory back to the system when a task ends: idle ones
    stay alive, and an executor's memory holds them and its JVM."""

    def trimmed(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return df.mapInArrow(trimmed, schema)
