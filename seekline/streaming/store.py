"""An index that grows by deliveries: immutable parts under one log of commits.

A delivery is written as a part of its own, postings and documents together,
and counts once the log has an entry that lists it; so postings and documents
never disagree, and what a crash leaves half written is not listed anywhere.
Parts of one level are merged into one of the next when there are ``fan`` of
them, so a row is rewritten as often as there are levels, not at every
delivery.  Postings lie in buckets by a hash of the term, and a look-up of
terms reads only theirs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekline.sources.tables import Files

POSTINGS = "term string, doc_id long, tf long, seq long, bucket int"
DOCUMENTS = "doc_id long, url string, title string, content string, seq long"


class IndexStore:
    """Postings and documents below ``root``, a folder all executors share. One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str, fan: int = 8, buckets: int = 32, keep: int = 2):
        self.spark, self.root, self.fan, self.buckets, self.keep = spark, root.rstrip("/"), fan, buckets, keep
        self.files = Files(spark)

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/log") if n.endswith(".json") and n[0] != "."), default=0)

    def parts(self, version: int | None = None) -> list[dict]:
        """The parts of a version, oldest first: folder, level and the number of its delivery."""
        v = self.version() if version is None else version
        return json.loads(self.files.text(f"{self.root}/log/{v:012d}.json")) if v else []

    def _commit(self, parts: list[dict], after: int) -> None:
        self.files.create(f"{self.root}/log/{after + 1:012d}.json", json.dumps(parts))

    def _write(self, postings: DataFrame, documents: DataFrame) -> str:
        name = f"part={uuid.uuid4().hex}"
        laid = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).select("term", "doc_id", "tf", "seq", "bucket")
        laid.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings/{name}")
        documents.select("doc_id", "url", "title", "content", "seq").write.parquet(f"{self.root}/documents/{name}")
        return name

    def append(self, postings: DataFrame, documents: DataFrame) -> int:
        """Add a delivery, (term, doc_id, tf) and (doc_id, url, title, content); a document that comes again replaces its row and all its postings.

        The same delivery given twice changes nothing that is read.
        """
        v = self.version()
        old = self.parts(v)
        seq = max((p["seq"] for p in old), default=0) + 1
        name = self._write(postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.lit(seq).cast("long").alias("seq")), documents.withColumn("seq", F.lit(seq).cast("long")))
        self._commit([*old, {"folder": name, "level": 0, "seq": seq}], v)
        self.compact()
        self.vacuum()
        return self.version()

    def _read(self, kind: str, schema: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, part string").option("basePath", f"{self.root}/{kind}").parquet(*[f"{self.root}/{kind}/{p['folder']}" for p in parts]).drop("part")

    def _living(self, rows: DataFrame, parts: list[dict]) -> DataFrame:
        """Rows of each document's last delivery; only documents that were delivered more than once are looked at."""
        if len(parts) < 2:
            return rows
        again = self._read("documents", DOCUMENTS, parts).groupBy("doc_id").agg(F.max("seq").alias("last"), F.min("seq").alias("first")).where("first < last").select("doc_id", "last")
        return rows.join(again, "doc_id", "left").where("last is null or seq = last").drop("last")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, doc_id, tf``, of the given terms only (a table with a column ``term``) if there are any."""
        parts = self.parts()
        rows = self._read("postings", POSTINGS, parts)
        if terms is not None:
            asked = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
            rows = rows.join(asked, ["bucket", "term"], "left_semi")
        return self._living(rows, parts).select("term", "doc_id", "tf")

    def documents(self) -> DataFrame:
        """``doc_id, url, title, content``."""
        parts = self.parts()
        return self._living(self._read("documents", DOCUMENTS, parts), parts).select("doc_id", "url", "title", "content")

    def compact(self) -> None:
        """Merge the parts of a level that has ``fan`` of them, level by level."""
        while True:
            v = self.version()
            parts = self.parts(v)
            full = [n for n in sorted({p["level"] for p in parts}) if sum(p["level"] == n for p in parts) >= self.fan]
            if not full:
                return
            merged = [p for p in parts if p["level"] == full[0]]
            alive = lambda kind, schema: self._living(self._read(kind, schema, merged), parts)  # noqa: E731, B023
            name = self._write(alive("postings", POSTINGS), alive("documents", DOCUMENTS))
            rest = [p for p in parts if p["level"] != full[0]]
            self._commit(sorted([*rest, {"folder": name, "level": full[0] + 1, "seq": max(p["seq"] for p in merged)}], key=lambda p: p["seq"]), v)

    def vacuum(self) -> None:
        """Remove log entries but the last ``keep``, and parts that none of these lists."""
        v = self.version()
        kept = range(max(1, v - self.keep + 1), v + 1)
        used = {p["folder"] for k in kept for p in self.parts(k)}
        for kind in ("postings", "documents"):
            for n in self.files.names(f"{self.root}/{kind}"):
                if n.startswith("part=") and n not in used:
                    self.files.delete(f"{self.root}/{kind}/{n}")
        for n in self.files.names(f"{self.root}/log"):
            if n.endswith(".json") and n[0] != "." and int(n[:-5]) not in kept:
                self.files.delete(f"{self.root}/log/{n}")
