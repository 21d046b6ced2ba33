"""Summaries from the best results: requests, replies and their reading are three steps over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings
from seekline.functions.text import parse_answer, strip_tags


def excerpts(results: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``query_id, excerpts``: the first results as numbered lines ``[i] title: snippet`` without marks."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), strip_tags(F.coalesce("snippet", F.lit(""))))
    top = results.where(F.col("rank") <= s.summary_inputs).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return top.select("query_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("excerpts"))


def requests(queries: DataFrame, results: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``query_id, reason, prompt, first``: what a model is asked, or why it isn't; ``first`` is the best excerpt's text."""
    text = F.col("query_text") if "query_text" in queries.columns else F.lit("")
    joined = queries.select("query_id", "intent", text.alias("query_text")).join(excerpts(results, s), "query_id", "left")
    reason = F.when(F.col("intent") == "navigational", "skipped_navigational").when(F.col("excerpts").isNull(), "no_results")
    ask = F.concat(F.lit("Question: "), F.coalesce("query_text", F.lit("")), F.lit("\n\n"), F.col("excerpts"), F.lit("\n\nWrite a short answer that rests on the numbered texts alone. Close with a line SOURCES: and quote what you relied on."))
    return joined.select("query_id", reason.alias("reason"), F.when(reason.isNull(), ask).alias("prompt"), F.regexp_extract("excerpts", r"^\[1\] [^\n]*?: ([^\n]*)", 1).alias("first"))


def _asked(model: Callable[[str], tuple[str | None, str | None]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for reason, prompt in zip(batch["reason"], batch["prompt"]):
                if prompt is None:
                    told.append((None, reason))
                    continue
                try:
                    reply, why = model(prompt)
                except Exception:
                    reply, why = None, "error"
                told.append((reply, None) if reply else (None, why or "error"))
            yield pd.DataFrame({"query_id": batch["query_id"], "reply": pd.Series([a for a, _ in told], dtype="object"), "reason": pd.Series([b for _, b in told], dtype="object")})

    return run


def summarize(queries: DataFrame, results: DataFrame, s: Settings = DEFAULTS, model: Callable[[str], tuple[str | None, str | None]] | None = None) -> DataFrame:
    """``query_id, reason, answer, sentences`` by ``model(prompt) -> (text, reason)``, which is sent to the executors.

    Without a model the first excerpt stands in for a reply.  ``queries`` has
    (query_id, intent) and may have ``query_text``.  A navigational query is
    skipped, one without results has none; a model that fails or has nothing to
    say gives its reason, a reply without an answer ``parse_failed``.
    """
    wanted = requests(queries, results, s)
    if model is None:
        told = wanted.select("query_id", F.when(F.col("reason").isNull(), F.concat("first", F.lit("\nSOURCES: "), "first")).alias("reply"), "reason")
    else:
        told = wanted.select("query_id", "reason", "prompt").mapInPandas(_asked(model), f"query_id {dict(queries.dtypes)['query_id']}, reply string, reason string")
    got = parse_answer(F.col("reply"))
    empty = F.col("reply").isNotNull() & (got["answer"] == "") if model is not None else F.lit(False)
    reason = F.when(empty, "parse_failed").otherwise(F.col("reason"))
    return told.select("query_id", reason.alias("reason"), F.when(reason.isNull(), got["answer"]).alias("answer"), F.when(reason.isNull(), got["sentences"]).alias("sentences"))
