"""Schemas of the engine's tables and results."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType



VECTOR = ArrayType(FloatType(), False)
DOCUMENTS = StructType([StructField("doc_id", LongType(), False), StructField("url", StringType(), False), StructField("title", StringType()), StructField("content", StringType()), StructField("created_at", TimestampType()), StructField("vector", VECTOR)])
LINKS = StructType([StructField("source_url", StringType(), False), StructField("target_url", StringType(), False)])
PAGERANK = StructType([StructField("url", StringType(), False), StructField("score", DoubleType(), False), StructField("updated_at", TimestampType())])
POSTINGS = StructType([StructField("term", StringType(), False), StructField("doc_id", LongType(), False), StructField("tf", LongType(), False)])
INVERTED_INDEX = StructType([StructField("term", StringType(), False), StructField("postings", StringType(), False)])
QUERY_LOG = StructType([StructField("id", LongType(), False), StructField("query_text", StringType()), StructField("result_count", IntegerType()), StructField("top_score", DoubleType()), StructField("latency_ms", IntegerType()), StructField("searched_at", TimestampType())])
PAGE_EVENT = StructType([StructField("url", StringType()), StructField("title", StringType()), StructField("text", StringType()), StructField("event_time", TimestampType())])
SCORES = StructType([StructField(n, DoubleType()) for n in ("bm25", "vector", "pagerank", "final")])
RESULT = StructType([StructField("doc_id", LongType()), StructField("url", StringType()), StructField("title", StringType()), StructField("snippet", StringType()), StructField("scores", SCORES)])
DICTIONARY = StructType([StructField("term", StringType(), False), StructField("freq", LongType(), False), StructField("len", IntegerType(), False)])
TITLES = StructType([StructField("folded", StringType(), False), StructField("title", StringType(), False), StructField("len", IntegerType(), False)])
GEOCODE = StructType([StructField("query", StringType()), StructField("lat", DoubleType()), StructField("lon", DoubleType()), StructField("display_name", StringType()), StructField("bounding_box", ArrayType(DoubleType())), StructField("expires_at", TimestampType())])
STAGE_EVENT = StructType([StructField("query_id", LongType()), StructField("seq", IntegerType()), StructField("event", StringType()), StructField("data", StringType())])
