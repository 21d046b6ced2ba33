"""The index kept up to date from a stream of new pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekline.operators import index
from seekline.schemas import PAGE_EVENT
from seekline.streaming.store import IndexStore


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines in a folder: the announced pages, and ``_corrupt`` for lines that can't be read."""
    raw = spark.readStream.text(path)
    parsed = F.from_json("value", PAGE_EVENT.simpleString().replace("struct<", "struct<_corrupt:string,"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.select(parsed.alias("e")).select("e.*")


def complete_events(events: DataFrame) -> DataFrame:
    """Readable events with url, title and text."""
    return events.where("_corrupt is null and length(url) > 0 and length(title) > 0 and length(text) > 0").drop("_corrupt")


def valid_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Complete events, each url once within the watermark."""
    return complete_events(events).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["url"])


def with_documents(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Events with title and text as the documents have them, joined by url as each batch comes; an event without a stored document keeps its own."""
    stored = docs.select("url", F.col("title").alias("stored_title"), F.col("content").alias("stored_text")).dropDuplicates(["url"])
    both = events.join(stored, "url", "left")
    return both.select("url", F.coalesce("stored_title", "title").alias("title"), F.coalesce("stored_text", "text").alias("text"), "event_time")


def corrupt_events(events: DataFrame) -> DataFrame:
    """The side table of lines that can't be read or lack a url."""
    return events.where("_corrupt is not null or url is null or url = ''")


class LiveIndex:
    """Postings and documents that a stream extends.

    Each micro-batch is one commit of both (see ``IndexStore``); a repeated
    batch changes nothing that is read, so replays after a failure are harmless.
    """

    def __init__(self, spark: SparkSession, root: str, **store):
        self.spark, self.store = spark, IndexStore(spark, root, **store)

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Documents are keyed by a hash of their url; a page that comes again replaces its text and all its postings."""
        docs = batch.select(F.xxhash64("url").alias("doc_id"), "url", "title", F.col("text").alias("content")).dropDuplicates(["url"]).persist()
        try:
            if not docs.isEmpty():
                self.store.append(index.postings(docs), docs)
        finally:
            docs.unpersist()

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        return self.store.postings(terms)

    def documents(self) -> DataFrame:
        return self.store.documents()

    def start(self, events: DataFrame, checkpoint: str, once: bool = True):
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
