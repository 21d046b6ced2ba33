"""The inverted index: tokens, postings, corpus statistics, dictionary, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings
from seekline.functions.text import text_or_empty, tokenize
from seekline.sources.tables import Files, spread


def tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, field, pos, term`` for title and content, in order."""
    one = lambda c: docs.select("doc_id", F.lit(c).alias("field"), F.posexplode(tokenize(text_or_empty(c))).alias("pos", "term"))
    return one("title").unionByName(one("content"))


def postings(docs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``term, doc_id, tf``: title tokens weigh 2, body tokens 1.

    Both fields are exploded in one pass, and Spark adds up inside each input
    partition before the one shuffle by (term, doc_id), so a frequent term is
    spread over its documents.
    """
    weighed = lambda c, w: F.transform(tokenize(text_or_empty(c), s.min_token), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    both = F.concat(weighed("title", s.title_weight), weighed("content", s.body_weight))
    docs = spread(docs.select("doc_id", "title", "content"))
    return docs.select("doc_id", F.explode(both).alias("t")).groupBy("t.term", "doc_id").agg(F.sum("t.w").alias("tf")).select("term", "doc_id", "tf")


def doc_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """``doc_id, len``: characters of title, blank and content, nulls as empty; at least 1."""
    return docs.select("doc_id", F.greatest(F.length(F.concat(text_or_empty("title"), F.lit(" "), text_or_empty("content"))), F.lit(1)).alias("len"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row ``n, avgdl``; an empty corpus counts as 1 and 1."""
    length = F.length(F.concat(text_or_empty("title"), F.lit(" "), text_or_empty("content")))
    got = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avgdl"))
    return got.select(F.when(F.col("n") == 0, 1).otherwise(F.col("n")).cast("long").alias("n"), F.coalesce(F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl")), F.lit(1.0)).alias("avgdl"))


def dictionary(posts: DataFrame) -> DataFrame:
    """``term, freq, len`` of the terms that occur at all, for spelling."""
    return posts.groupBy("term").agg(F.sum("tf").alias("freq")).where("freq > 0").select("term", "freq", F.length("term").alias("len"))


def to_json(posts: DataFrame) -> DataFrame:
    """``term, postings``: a JSON object from document to count, in the order of the identifiers.

    A compatibility view: the engine itself keeps the long form, since one row
    of a frequent term grows with the corpus.
    """
    entries = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    as_map = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["doc_id"].cast("string"), e["tf"])))
    return posts.groupBy("term").agg(F.to_json(as_map).alias("postings"))


def from_json(index: DataFrame) -> DataFrame:
    """``term, doc_id, tf`` of stored JSON rows, terms trimmed and in lower case, the largest count of repeats; broken JSON is skipped."""
    whole = F.when(F.col("postings").rlike(r"^\s*\{[\s\S]*\}\s*$"), F.from_json("postings", "map<string,bigint>"))
    rows = spread(index.select("term", "postings")).select(F.trim(F.lower("term")).alias("term"), F.explode(whole).alias("doc", "tf"))
    return rows.select("term", F.expr("try_cast(doc as bigint)").alias("doc_id"), "tf").where("term <> '' and doc_id is not null").groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))


def merge(old: DataFrame, new: DataFrame, replace_docs: bool = False) -> DataFrame:
    """Postings after a delivery: new counts win per (term, doc_id), so a repeated delivery changes nothing.

    ``replace_docs`` first drops all old postings of the delivered documents,
    which otherwise keep terms that vanished from them.
    """
    keys = ["doc_id"] if replace_docs else ["term", "doc_id"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new)


def merge_json(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same for JSON rows (term, postings): a shallow merge, the right side winning."""
    parse = lambda c: F.from_json(c, "map<string,bigint>")
    joined = old.select("term", parse("postings").alias("a")).join(new.select("term", parse("postings").alias("b")), "term", "full_outer")
    empty = F.create_map().cast("map<string,bigint>")
    merged = F.map_zip_with(F.coalesce("a", empty), F.coalesce("b", empty), lambda k, x, y: F.coalesce(y, x))
    ordered = F.map_from_entries(F.transform(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.struct(e["key"].cast("long").alias("k"), e["value"].alias("v")))), lambda e: F.struct(e["k"].cast("string"), e["v"])))
    return joined.select("term", F.to_json(ordered).alias("postings"))


def insert_if_absent(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """The rows of ``new`` that are really inserted: keys neither stored nor repeated (one row of a repeated key stays)."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


class VersionedTable:
    """A table kept as numbered whole versions; the greatest one whose write was completed counts.

    A version is a folder that Spark marks as its last step, so there is no
    pointer that could be lost: a crash at any moment leaves the version before
    as it was, and a reader sees one whole version.  One writer at a time.
    ``path`` is a folder on the file system all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.files = Files(spark)

    def version(self) -> int:
        found = [int(n[1:]) for n in self.files.names(self.path) if n[:1] == "v" and n[1:].isdigit()]
        return next((v for v in sorted(found, reverse=True) if self.files.exists(f"{self.path}/v{v}/_SUCCESS")), 0)

    def read(self, schema=None) -> DataFrame:
        v = self.version()
        if not v:
            if schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame, buckets: int | None = None, key: str = "term") -> int:
        """Write the next version, range-partitioned by ``key`` so that a filter on it prunes files."""
        v = self.version() + 1
        laid = df.repartitionByRange(buckets, key) if buckets else df.repartitionByRange(key)
        laid.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.path}/v{v}")
        for n in self.files.names(self.path):
            if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) <= v - self.keep:
                self.files.delete(f"{self.path}/{n}")
        return v
