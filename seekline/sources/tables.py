"""Readers of the engine's tables and small file connectors.

A table is found as ``<dir>/<name>.parquet``, a single file or a folder of
part files.  Only the scan is declared here: Catalyst prunes columns and pushes
filters down into it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table ``name`` below ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int = 32, fetch: int = 500) -> DataFrame:
    """A row-store table read in ``parts`` ranges of ``key``, ``fetch`` rows a round trip."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties={"fetchsize": str(fetch)})


class Files:
    """Names, small texts and renames on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def text(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A file that appears whole under its name or not at all; an error where the name is taken."""
        at, fs = self._at(path)
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(at) or not fs.rename(fresh, at):
            fs.delete(fresh, False)
            raise FileExistsError(path)

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)


def by_url(docs: DataFrame, url: str) -> DataFrame:
    """The documents of one url; the filter goes down into the scan."""
    from pyspark.sql import functions as F

    return docs.where(F.col("url") == F.lit(url))


def page(df: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The next ``size`` rows in the order of ``key`` behind the value ``after`` (from the start without one).

    A reader goes on from the last key it has seen, so a page costs a filtered
    scan with a bounded heap however far in it lies; rows with a null key are on no page.
    """
    from pyspark.sql import functions as F

    rest = df.where(F.col(key).isNotNull()) if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header and quoted commas (captured crawl results)."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file of one trimmed, non-empty value per line (captured links)."""
    from pyspark.sql import functions as F

    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Sink of one JSON object per row, as for the expansion log."""
    df.write.mode(mode).json(path)


def publish(documents: DataFrame, path: str) -> None:
    """Announce new documents (url, title, content) as JSON lines ``url, title, text, event_time`` in the folder a stream reads."""
    from pyspark.sql import functions as F

    at = F.col("created_at") if "created_at" in documents.columns else F.current_timestamp()
    documents.select("url", "title", F.col("content").alias("text"), at.alias("event_time")).write.mode("append").json(path)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of ``new`` put in place of rows of the same key, or added."""
    return stored.join(new.select(key).distinct(), key, "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for explicit repartitioning."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bare(plan) -> bool:
    """Whether a plan only scans, projects and filters, so that its tasks can be counted without running any."""
    below = plan.children()
    if below.isEmpty():
        return plan.nodeName() in ("LogicalRelation", "LocalRelation")
    return plan.nodeName() in ("Project", "Filter") and _bare(below.head())


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are cores, for work that costs far more than moving the rows.

    A large input has more tasks than that and is left as it is, and so is
    what isn't a bare scan, since planning its tasks could run stages.
    """
    if not _bare(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
