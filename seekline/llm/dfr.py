"""How characteristic a term is of a record: divergence from randomness (problem 6).

The information of a count under a geometric collection model is multiplied by
Laplace's after-effect gain, the count being normalised by document length:

    tfn  = tf * log2(1 + mean_length / length)
    info = log2(1 + rate) + tfn * log2((1 + rate) / rate)
    dfr  = info / (tfn + 1)

``rate`` is the mean number of occurrences (``rate="occurrence"``) or the share
of documents with the term (``rate="presence"``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekline.llm.postings import clean_postings, hot_limit
from seekline.plans.lineage import materialize


def dfr_scores(index: DataFrame, rate: str = "occurrence") -> DataFrame:
    """``doc_id, term, tf, df, docs, tfn, rate, dfr`` for every posting.

    Terms and postings are cleaned and united first.  Counts below one are
    skipped.  A document's length is the sum of its counts.
    """
    if rate not in ("occurrence", "presence"):
        raise ValueError("rate must be occurrence or presence")
    each = clean_postings(index).select("term", "df", "total", "tfs", F.posexplode("docs").alias("at", "doc_id"))
    flat = each.select("term", "df", "total", "doc_id", F.get("tfs", F.col("at")).alias("tf")).where("tf > 0")
    lengths = materialize(flat.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count(F.lit(1)).alias("n")), "lengths")
    # One row, so it may be broadcast.
    corpus = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length")))
    share = (F.col("total") if rate == "occurrence" else F.col("df")) / F.col("docs")
    tfn = F.col("tf") * F.log2(1 + F.col("mean_length") / F.col("length"))
    # Documents that hold more than their share of all postings meet their length by a broadcast of those few.
    spark = index.sparkSession
    hot = lengths.where(F.col("n") >= hot_limit(spark, lengths.agg(F.sum("n")).first()[0] or 0)).select("doc_id", "length")
    of_each = lengths.select("doc_id", "length")
    if hot.isEmpty():
        joined = flat.join(of_each, "doc_id")
    else:
        hot = F.broadcast(hot)
        joined = flat.join(hot, "doc_id", "left_anti").join(of_each, "doc_id").unionByName(flat.join(hot, "doc_id"))
    joined = joined.crossJoin(corpus)
    scored = joined.select("doc_id", "term", "tf", "df", "docs", tfn.alias("tfn"), share.alias("rate"))
    info = F.log2(1 + F.col("rate")) + F.col("tfn") * F.log2((1 + F.col("rate")) / F.col("rate"))
    return scored.withColumn("dfr", info / (F.col("tfn") + 1))


def _top(df: DataFrame, keys: list[str], score: str, k: int) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("term"))
    return df.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def characteristic_terms(index: DataFrame, k: int = 3) -> DataFrame:
    """Each document's ``k`` terms of the highest divergence from randomness; on equal score the smaller term by bytes comes first.

    An empty index gives no rows; documents with fewer terms give fewer rows.
    """
    scored = dfr_scores(index).withColumn("place", F.round("dfr", 9))  # what differs only by the order of additions is equal
    return _top(scored, ["doc_id"], "place", k).select("doc_id", "term", "tf", "dfr", "rank")


def characteristic_terms_checked(index: DataFrame, k: int = 3) -> DataFrame:
    """Divergence from randomness proposes terms, ``(1 + ln tf) * ln(docs / df)`` decides among them: ``doc_id, term, score, rank``.

    No term that belongs in the result is lost.  For one document and one tf,
    the score with ``rate = df / docs`` falls strictly as df rises while
    ``rate < tfn``, so its order there is the checked weight's order, and the
    ``k`` best of each (document, tf) hold every term that can win.  Postings
    with ``rate >= tfn``, which the model can't order, all go to the check.
    """
    scored = dfr_scores(index, "presence")
    ordered = F.col("rate") < F.col("tfn")
    group = Window.partitionBy("doc_id", "tf", "ordered").orderBy(F.desc("dfr"), F.asc("df"), F.asc("term"))
    proposed = scored.withColumn("ordered", ordered).withColumn("at", F.row_number().over(group)).where(~F.col("ordered") | (F.col("at") <= k))
    weight = (1 + F.log("tf")) * F.log(F.col("docs") / F.col("df"))
    return _top(proposed.withColumn("score", weight), ["doc_id"], "score", k).select("doc_id", "term", "score", "rank")
