"""How the base tables lie on disk, so that look-ups prune what they read.

A file format has no secondary indexes; rows sorted by the looked-up column,
with bloom filters where it has many values, take their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table, order of its rows and column of its bloom filter; links lie twice, once for each end.
LAYOUTS = {
    "documents": ("documents", "url", "url"),
    "links_by_source": ("links", "source_url", "source_url"),
    "links_by_target": ("links", "target_url", "target_url"),
    "pagerank": ("pagerank", "url", "url"),
    "inverted_index": ("inverted_index", "term", "term"),
}


def lay_out(tables: dict[str, DataFrame], root: str) -> None:
    """Write the given base tables below ``root``: sorted by range of the looked-up column, the query log by day."""
    for name, (source, order, bloom) in LAYOUTS.items():
        if source in tables:
            laid = tables[source].repartitionByRange(order).sortWithinPartitions(order)
            laid.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{bloom}", "true").parquet(f"{root}/{name}")
    if "query_log" in tables:
        by_day = tables["query_log"].withColumn("day", F.to_date("searched_at"))
        by_day.repartitionByRange("day", "searched_at").sortWithinPartitions("searched_at").write.mode("overwrite").partitionBy("day").parquet(f"{root}/query_log")


def laid(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")
