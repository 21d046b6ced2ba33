"""Dashboards over the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings


def top_queries(log: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``query_text, hits``: the most frequent texts; on equal hits the smaller text comes first."""
    return log.groupBy("query_text").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "query_text").limit(s.top_queries)


def zero_results(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("result_count") == 0).alias("zero_result_count"))


def average_top_score(log: DataFrame) -> DataFrame:
    """An empty log, or one without scores, has the average 0."""
    return log.agg(F.coalesce(F.avg("top_score"), F.lit(0.0)).alias("avg_top_score"))


def score_buckets(log: DataFrame) -> DataFrame:
    """Counts of five equal ranges of 0..1, the last closed; other scores count nowhere, an empty log gives nulls."""
    x = F.col("top_score")
    cuts = [0.0, 0.2, 0.4, 0.6, 0.8]
    inside = lambda i: (x >= cuts[i]) & ((x < cuts[i + 1]) if i < 4 else (x <= 1.0))
    return log.agg(*[F.sum(F.when(inside(i), 1).otherwise(0)).alias(f"b{i}") for i in range(5)])


def bucket_shares(log: DataFrame) -> DataFrame:
    """``bucket, n, share``; where nothing is counted every share is 0."""
    b = score_buckets(log)
    total = sum((F.coalesce(F.col(f"b{i}"), F.lit(0)) for i in range(5)), F.lit(0))
    one = F.array(*[F.struct(F.lit(f"b{i}").alias("bucket"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("n")) for i in range(5)])
    return b.select(F.explode(one).alias("x"), F.when(total == 0, 1).otherwise(total).alias("t")).select("x.bucket", "x.n", (F.col("x.n") / F.col("t")).alias("share"))


def hit_ratios(log: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The most frequent texts with their hits as a share of the first one's."""
    return top_queries(log, s).select("query_text", "hits", (F.col("hits") / F.max("hits").over(Window.partitionBy())).alias("ratio"))


def trending(log: DataFrame, as_of: Column | str | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """``query_text, hits, latest`` of the days before ``as_of`` (now, if none): a row exactly that old is out."""
    now = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.to_timestamp(F.lit(as_of))
    recent = log.where(F.col("searched_at") > now - F.make_interval(days=F.lit(s.trending_days)))
    return recent.groupBy("query_text").agg(F.count(F.lit(1)).alias("hits"), F.max("searched_at").alias("latest")).orderBy(F.desc("hits"), F.desc("latest"), "query_text").limit(s.trending)


def corpus_counts(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """One row ``documents, terms``."""
    return docs.agg(F.count(F.lit(1)).alias("documents")).crossJoin(F.broadcast(posts.agg(F.count_distinct("term").alias("terms"))))


def history(events: DataFrame, user: str, text: str, at: str, s: Settings = DEFAULTS) -> DataFrame:
    """``<user>, query_text, rank``: each user's last distinct searches, newest first."""
    last = events.where(F.col(text).isNotNull() & F.col(user).isNotNull()).groupBy(user, F.col(text).alias("query_text")).agg(F.max(at).alias("last"))
    order = Window.partitionBy(user).orderBy(F.desc("last"), "query_text")
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.history).select(user, "query_text", "rank")


def log_rows(results: DataFrame) -> DataFrame:
    """Rows for the query log from (query_id, original, n, top, latency_ms): the uncorrected text is kept."""
    return results.select(F.col("query_id").alias("id"), F.trim("original").alias("query_text"), F.col("n").cast("int").alias("result_count"), F.col("top").alias("top_score"), F.col("latency_ms").cast("int"), F.current_timestamp().alias("searched_at"))
