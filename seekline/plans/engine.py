"""The engine as one object: build the index, search, suggest, report."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, INDEX_STOP_WORDS, Settings
from seekline.functions.edit import osa_udf
from seekline.functions.snippet import snippet, snippet_udf
from seekline.functions.text import classify_intent, expand_terms, query_tokens
from seekline.operators import analytics, answer, bm25, graph, hybrid, index, spell, suggest, vectors
from seekline.plans.lineage import materialize
from seekline.sources.adapters import Geocoder, Model, no_model, synonyms_of, within


def register_functions(spark: SparkSession) -> None:
    """SQL functions: tokenize, query_tokens, classify_intent, cosine_sim, osa_distance, snippet, bm25_term."""
    spark.udf.register("osa_distance", osa_udf())
    spark.udf.register("snippet", snippet_udf())
    quoted = ", ".join(f"'{w}'" for w in INDEX_STOP_WORDS)
    define = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{define} tokenize(t STRING) RETURNS ARRAY<STRING> RETURN filter(transform(filter(split(t, '[^A-Za-z0-9]+'), x -> length(x) >= 2), x -> lower(x)), x -> x NOT IN ({quoted}))")
    spark.sql(f"{define} query_tokens(q STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(q), '[a-z0-9]+', 0)")
    spark.sql(f"{define} cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))")
    spark.sql(f"{define} bm25_term(tf DOUBLE, df DOUBLE, n DOUBLE, dl DOUBLE, avgdl DOUBLE) RETURNS DOUBLE RETURN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))")


class Engine:
    """All operators over one set of tables.

    ``docs`` has (doc_id, url, title, content), ``links`` (source_url,
    target_url), ``embeddings`` (doc_id, vector).  Derived tables are written
    to the shared folder once and reused by every query.
    """

    def __init__(self, docs: DataFrame, links: DataFrame, embeddings: DataFrame, log: DataFrame | None = None, settings: Settings = DEFAULTS, scores: DataFrame | None = None, model: Model = no_model, geocoder: Geocoder | None = None):
        self.spark, self.docs, self.links, self.embeddings, self.log, self.s, self.model = docs.sparkSession, docs, links, embeddings, log, settings, model
        self.geocoder = geocoder or Geocoder(lambda q: None)
        self._scores = scores
        self._made: dict[str, DataFrame] = {}

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make(), name)
        return self._made[name]

    def refresh(self) -> None:
        """Forget derived tables, so that the next use reads the base tables again."""
        self._made.clear()

    @property
    def postings(self) -> DataFrame:
        return self._table("postings", lambda: index.postings(self.docs, self.s))

    @property
    def lengths(self) -> DataFrame:
        return self._table("lengths", lambda: index.doc_lengths(self.docs))

    @property
    def stats(self) -> DataFrame:
        return self._table("stats", lambda: index.corpus_stats(self.docs))

    @property
    def dictionary(self) -> DataFrame:
        return self._table("dictionary", lambda: index.dictionary(self.postings))

    @property
    def titles(self) -> DataFrame:
        return self._table("titles", lambda: suggest.titles(self.docs))

    @property
    def pagerank(self) -> DataFrame:
        return self._table("pagerank", lambda: self._scores if self._scores is not None else graph.pagerank(self.links, self.docs, self.s)[0])

    def search(self, queries: DataFrame, synonyms: DataFrame | None = None, correct: bool = True) -> DataFrame:
        """``query_id, original, corrected, intent, expanded_terms, rank, doc_id, url, title, snippet, scores`` of each query's best.

        ``queries`` has (query_id, query_text) and may have a ``vector``;
        ``synonyms`` (query_id, phrases).  Blank queries are left out.  One
        lazy plan serves all queries; contents are joined to ranked rows only.
        """
        asked = queries.where("trim(query_text) <> ''")
        if correct:
            fixed = materialize(spell.correct(asked, self.dictionary, s=self.s), "corrected")
        else:
            fixed = asked.select("query_id", F.col("query_text").alias("original"), F.col("query_text").alias("corrected"), F.lit(False).alias("was_changed"))
        if synonyms is not None:
            fixed = fixed.join(synonyms.select("query_id", "phrases"), "query_id", "left")
        else:
            fixed = fixed.withColumn("phrases", F.lit(None).cast("array<string>"))
        plan = fixed.select("query_id", "original", "corrected", "was_changed", classify_intent(F.col("corrected")).alias("intent"), expand_terms(F.col("corrected"), F.col("phrases")).alias("terms"))
        text = bm25.score(plan, self.postings, self.lengths, self.stats, self.s)
        if "vector" in queries.columns:
            near = vectors.knn(asked.where("vector is not null"), self.embeddings, self.s.knn_depth).select("query_id", "doc_id", "similarity")
        else:
            near = self.spark.createDataFrame([], "query_id long, doc_id long, similarity double")
        ranked = hybrid.with_content(hybrid.rank(text, near, self.docs, self.pagerank, self.s), self.docs)
        out = ranked.join(plan, "query_id")
        return out.select(
            "query_id", "original", "corrected", "was_changed", "intent", F.col("terms").alias("expanded_terms"), "rank", "doc_id", "url", "title",
            snippet("content", query_tokens(F.col("corrected"))).alias("snippet"),
            F.struct("bm25", "vector", "pagerank", "final").alias("scores"),
        )

    def plan(self, queries: DataFrame) -> str:
        """How a search would be run: the formatted plan, nothing of it executed but the derived tables it reads."""
        df = self.search(queries, correct=False)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def log_entries(self, results: DataFrame, latency_ms: int) -> DataFrame:
        """Rows for the query log: the uncorrected query, its number of results and the best final score."""
        top = results.groupBy("query_id", "original").agg(F.count(F.lit(1)).alias("n"), F.max("scores.final").alias("top"))
        return analytics.log_rows(top.withColumn("latency_ms", F.lit(latency_ms)))

    def stream_search(self, query: str, vector: list[float] | None = None, gone: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, dict]]:
        """Named events of one search, stage by stage; a failing stage falls back instead of ending the rest.

        The search ends between stages once ``gone()`` is true, and its running
        jobs are cancelled when the reader closes the iterator.
        """
        context, group = self.spark.sparkContext, f"search-{uuid.uuid4().hex}"
        context.setJobGroup(group, "staged search", True)
        try:
            for event in self._stages(query, vector):
                yield event
                if gone():
                    return
        finally:
            context.cancelJobGroup(group)
            context.setLocalProperty("spark.jobGroup.id", None)

    def _stages(self, query: str, vector: list[float] | None) -> Iterator[tuple[str, dict]]:
        query = query.strip()
        if not query:
            yield "error", {"message": "empty query"}
            return
        began = time.time()
        one = self.spark.createDataFrame([(0, query, vector)], "query_id long, query_text string, vector array<float>")
        try:
            r = spell.correct(one, self.dictionary, s=self.s).first()
            corrected, changed = r["corrected"], r["was_changed"]
        except Exception:
            corrected, changed = query, False
        yield "spellcheck", {"original": query, "corrected": corrected, "wasChanged": changed}
        phrases = within(self.s.expansion_timeout, lambda: synonyms_of(self.model(f"Other wordings of: {corrected}\nReply as JSON: a list of at most four strings.")[0]), [])
        given = self.spark.createDataFrame([(0, corrected, phrases)], "query_id long, q string, phrases array<string>")
        e = given.select(classify_intent(F.col("q")).alias("intent"), expand_terms(F.col("q"), F.col("phrases")).alias("terms")).first()
        yield "expansion", {"intent": e["intent"], "expandedTerms": e["terms"], "synonyms": phrases}
        asked = self.spark.createDataFrame([(0, corrected, vector)], "query_id long, query_text string, vector array<float>")
        found = self.search(asked if vector else asked.drop("vector"), given, correct=False).orderBy("rank").collect()
        results = [{"id": r["doc_id"], "url": r["url"], "title": r["title"], "snippet": r["snippet"], "scores": r["scores"].asDict()} for r in found]
        yield "results", {"results": results, "latencyMs": int(1000 * (time.time() - began))}
        try:
            shown = self.spark.createDataFrame([(0, i, r["title"], r["snippet"]) for i, r in enumerate(results, 1)], "query_id long, rank int, title string, snippet string")
            asked = self.spark.createDataFrame([(0, corrected, e["intent"])], "query_id long, query_text string, intent string")
            got = answer.summarize(asked, shown, self.s, self.model).first()
            summary = {"answer": {"text": got["answer"], "sourceSentences": got["sentences"]} if got["reason"] is None else None, "reason": got["reason"]}
        except Exception:
            summary = {"answer": None, "reason": "error"}
        yield "summary", summary
        yield "done", {"latencyMs": int(1000 * (time.time() - began))}

    def suggest(self, prefix: str) -> DataFrame:
        return suggest.suggest(self.titles, prefix, self.s)

    def summarize(self, queries: DataFrame, results: DataFrame) -> DataFrame:
        return answer.summarize(queries, results, self.s)

    def geocode(self, query: str) -> dict:
        return self.geocoder.find(query)

    def analytics(self) -> dict[str, DataFrame]:
        """The dashboard's parts, each lazy."""
        return {
            "topQueries": analytics.top_queries(self.log, self.s),
            "zeroResultCount": analytics.zero_results(self.log),
            "avgTopScore": analytics.average_top_score(self.log),
            "scoreBuckets": analytics.score_buckets(self.log),
            "counts": analytics.corpus_counts(self.docs, self.postings),
        }

    def trending(self, as_of=None) -> DataFrame:
        return analytics.trending(self.log, as_of, self.s)

    def health(self) -> dict:
        """Whether each part answers, and the counts the service reports."""
        got: dict = {"ok": True}
        for name, df in (("documents", self.docs), ("dictionary", self.dictionary), ("titles", self.titles)):
            try:
                got[name] = df.count()
            except Exception as e:
                got |= {"ok": False, name: str(e)[:200]}
        return got

