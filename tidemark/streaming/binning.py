"""Weekly or daily counts of a stream of posts, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bin_stream(posts: DataFrame, *, time: str, keys: list[str], every: str = "7 days", start: str = "4 days", late: str = "14 days") -> DataFrame:
    """(period, keys, post_count) of a streaming or batch table. Windows of 7 days that start 4 days after the epoch
    begin on Mondays. State is bounded by the watermark; rows later than it are dropped by a stream."""
    rows = posts.withColumn("__t", F.col(time).cast("timestamp")).where("__t IS NOT NULL").withWatermark("__t", late)
    binned = rows.groupBy(F.window("__t", every, startTime=start).alias("w"), *keys).agg(F.count(F.lit(1)).alias("post_count"))
    return binned.select(F.col("w.start").cast("date").alias("period"), *keys, "post_count")


def spikes_in_batch(batch: DataFrame, *, keys: list[str], threshold: float = 1.5) -> DataFrame:
    """For foreachBatch: trailing scores of the closed windows of a micro-batch."""
    from tidemark.operators.series import trailing_z

    return trailing_z(batch, keys=keys, value="post_count", threshold=threshold)
