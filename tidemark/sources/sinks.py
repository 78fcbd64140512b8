"""Writers. Parquet is the format of record; nested columns become JSON text at a CSV edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write(df: DataFrame, path: str, *, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, drop: list[str] | None = None) -> None:
    """Writes parquet, json, orc or csv; drop names columns that stay in memory only, such as vectors."""
    out = df.drop(*drop) if drop else df
    out = flat(out) if fmt == "csv" else out
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_embeddings(df: DataFrame, path: str, *, id_col: str = "post_id", vector: str = "embedding", text: str | None = None) -> None:
    """post_id string, embedding array<float>[, text string]."""
    columns = [F.col(id_col).cast("string").alias("post_id"), F.col(vector).cast("array<float>").alias("embedding")]
    df.select(*columns, *([F.col(text).alias("text")] if text else [])).write.mode("overwrite").parquet(path)
