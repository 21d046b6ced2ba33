"""The query log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trending_windows(log: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """``window, query_text, hits, latest`` over sliding windows; rows later than ``delay`` are dropped."""
    return log.withWatermark("searched_at", delay).groupBy(F.window("searched_at", length, slide), "query_text").agg(F.count(F.lit(1)).alias("hits"), F.max("searched_at").alias("latest"))


def append(log: DataFrame, path: str, checkpoint: str):
    """Appends a stream of log rows to a parquet table, by day."""
    return log.withColumn("day", F.to_date("searched_at")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()


def keep_windows(windows: DataFrame, path: str, checkpoint: str):
    """Keeps the windows as a table (begins, query_text, hits, latest) that each batch replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("window.start").alias("begins"), "query_text", "hits", "latest").write.mode("overwrite").parquet(path)

    return windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
