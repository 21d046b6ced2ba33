"""BM25 for a whole table of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def query_terms(queries: DataFrame, terms: str = "terms") -> DataFrame:
    """``query_id, term``: distinct terms in lower case without empty ones; how often a query names a term doesn't count."""
    return queries.select("query_id", F.explode(F.array_distinct(F.transform(F.col(terms), F.lower))).alias("term")).where("term <> ''")


def score(queries: DataFrame, posts: DataFrame, lengths: DataFrame, stats: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``query_id, doc_id, score`` of every document that holds a term of the query.

    ``queries`` has (query_id, terms).  Postings are cut to the asked terms
    before anything else; document frequencies are counted on these only.
    Documents without a length get the average.  Token counts are set against
    character lengths.
    """
    asked = query_terms(queries)
    hit = posts.join(asked.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    one = F.broadcast(stats)  # a single row
    weight = df.crossJoin(one).select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    rows = hit.join(weight, "term").join(lengths, "doc_id", "left")
    norm = 1 - s.b + s.b * F.coalesce(F.col("len"), F.col("avgdl")) / F.col("avgdl")
    part = F.col("idf") * F.col("tf") * (s.k1 + 1) / (F.col("tf") + s.k1 * norm)
    return rows.select("term", "doc_id", part.alias("part")).join(asked, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
