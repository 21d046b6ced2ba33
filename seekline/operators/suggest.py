"""Autocomplete over titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings


def _order() -> list[Column]:
    """Titles as a reader sorts them: by the collation of Unicode, and by bytes where that finds them equal."""
    return [F.collate("title", "UNICODE"), F.col("title")]


def titles(docs: DataFrame) -> DataFrame:
    """``folded, title, len``: one title (the greatest by bytes) for each text in lower case; null and empty titles have none."""
    return docs.where("title is not null and title <> ''").groupBy(F.lower("title").alias("folded")).agg(F.max("title").alias("title")).select("folded", "title", F.length("title").alias("len"))


def suggest(index: DataFrame, prefix: str, s: Settings = DEFAULTS) -> DataFrame:
    """``title, len`` of the shortest titles that begin with the prefix; a blank prefix gives none."""
    wanted = prefix.strip().lower()
    hits = index.where(F.startswith(F.col("folded"), F.lit(wanted))) if wanted else index.limit(0)
    return hits.orderBy("len", *_order()).limit(s.suggest_limit).select("title", "len")


def suggest_many(index: DataFrame, prefixes: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``prefix, title, rank`` for a table of prefixes: titles are joined on their own beginnings of the lengths asked for."""
    asked = prefixes.select(F.lower(F.trim("prefix")).alias("prefix")).where("prefix <> ''").distinct().withColumn("n", F.length("prefix"))
    lengths = F.broadcast(asked.agg(F.collect_set("n").alias("ns")))  # as many as there are lengths of a prefix
    forms = index.crossJoin(lengths).select("title", "len", "folded", F.explode(F.filter("ns", lambda n: n <= F.length("folded"))).alias("n")).select("title", "len", F.substr(F.col("folded"), F.lit(1), F.col("n")).alias("prefix"))
    at = Window.partitionBy("prefix").orderBy("len", *_order())
    return forms.join(asked.select("prefix"), "prefix").withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= s.suggest_limit).select("prefix", "title", "rank")
