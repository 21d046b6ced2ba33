"""Fusing text, vector and link scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings


def min_max(value: Column, *keys: str) -> Column:
    """(v - min) / (max - min) within the keys; a range of 0 makes every value 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.0).otherwise((value - low) / (high - low))


def rank(bm25: DataFrame, near: DataFrame, docs: DataFrame, pagerank: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``query_id, rank, doc_id, url, bm25, vector, pagerank, final`` of each query's best.

    ``bm25`` is (query_id, doc_id, score), ``near`` (query_id, doc_id,
    similarity).  BM25 is normalised over all its documents, similarity over
    the nearest, link scores over the candidates that have a row in ``docs``;
    a missing signal is 0.  Scores are rounded, and the rounded final decides;
    on equal finals the smaller doc_id comes first.
    """
    text = bm25.select("query_id", "doc_id", min_max(F.col("score"), "query_id").alias("bm25"))
    vec = near.select("query_id", "doc_id", min_max(F.col("similarity"), "query_id").alias("vector"))
    both = text.join(vec, ["query_id", "doc_id"], "full_outer")
    urls = docs.select("doc_id", "url")
    held = both.join(urls, "doc_id").join(pagerank.select("url", F.col("score").alias("pr")), "url", "left")
    held = held.withColumn("pr", F.coalesce("pr", F.lit(0.0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = held.select("query_id", "doc_id", "url", zero("bm25").alias("bm25"), zero("vector").alias("vector"), min_max(F.col("pr"), "query_id").alias("pagerank"))
    final = s.weight_bm25 * F.col("bm25") + s.weight_vector * F.col("vector") + s.weight_pagerank * F.col("pagerank")
    rounded = scored.select("query_id", "doc_id", "url", *[F.round(c, s.decimals).alias(c) for c in ("bm25", "vector", "pagerank")], F.round(final, s.decimals).alias("final"))
    at = Window.partitionBy("query_id").orderBy(F.desc("final"), F.asc("doc_id"))
    return rounded.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= s.result_limit)


def with_content(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Titles and contents joined only to the ranked rows."""
    return ranked.join(docs.select("doc_id", "title", "content"), "doc_id", "left")
