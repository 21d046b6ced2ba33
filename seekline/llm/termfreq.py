"""Frequency of every distinct term (problem 4).

A term's postings are united first, since a document counts once.  A global
dictionary numbers the distinct terms densely, the counts are encoded to these
integers, every task adds them up in count arrays of one block of identifiers
after the other, and the arrays of a block are summed.  A term that holds more
than its share of all postings is united in pieces, by document, and its pieces
meet in its block's arrays, so no task gets all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.llm.postings import clean_rows, documents, term_rows
from seekline.plans.lineage import materialize
from seekline.sources.tables import partitions

#: Identifiers of one count array.
BLOCK = 1 << 11


def build_dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """Distinct values of ``column`` with dense identifiers 0, 1, 2, ... in the order of their bytes.

    Values are range partitioned and numbered inside each partition; the
    partitions' sizes (as many numbers as partitions) give the offsets.
    """
    spark = terms.sparkSession
    parts = partitions(spark)
    ordered = terms.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(parts, column).sortWithinPartitions(column)
    local = materialize(ordered.select(column, F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("at")), "dictionary")
    sizes = {r["part"]: r["n"] for r in local.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return local.select(column, F.col("at").alias("term_id"))
    offsets = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])
    return local.select(column, (F.col("at") + offsets[F.col("part")]).cast("long").alias("term_id"))


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds rows (term_id, total, docs), sorted by block, up in the array of the block at hand."""
    block, array = -1, np.zeros((2, BLOCK), np.int64)

    def out():
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "arrays": pa.array([array.tobytes()], pa.binary())})

    for batch in batches:
        ids, total, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        for b in np.unique(ids // BLOCK).tolist():
            if b != block:
                if block >= 0:
                    yield out()
                block, array = b, np.zeros((2, BLOCK), np.int64)
            here = ids // BLOCK == b
            np.add.at(array[0], ids[here] - b * BLOCK, total[here])
            np.add.at(array[1], ids[here] - b * BLOCK, docs[here])
    if block >= 0:
        yield out()


def _sum_block(key, table):
    total = np.zeros((2, BLOCK), np.int64)
    for raw in table.column("arrays"):
        total += np.frombuffer(raw.as_buffer(), np.int64).reshape(2, BLOCK)
    at = np.flatnonzero(total[1])
    return pa.table({"term_id": at + key[0].as_py() * BLOCK, "total_count": total[0][at], "doc_count": total[1][at]})


def term_frequencies(index: DataFrame, rare_docs: int = 2, common_share: float = 0.2) -> DataFrame:
    """``term, total_count, doc_count, mark`` for every distinct cleaned term that has a posting.

    A document counts once per term, with its largest count.  ``mark`` is
    ``rare`` up to ``rare_docs`` documents, ``common`` from ``common_share`` of
    the documents that have any posting, else null; a term that is both is
    ``rare``.  Null terms and postings, blank terms and cut-off JSON are
    skipped; an empty index gives no rows.
    """
    rows = term_rows(index)
    counts, _ = clean_rows(rows, lists=False)
    words = build_dictionary(counts)
    coded = counts.join(words, "term").select("term_id", "total", "df").withColumn("block", F.floor(F.col("term_id") / BLOCK))
    laid = coded.repartition(partitions(index.sparkSession), "block").sortWithinPartitions("block").select("term_id", "total", "df")
    sums = laid.mapInArrow(_count_blocks, "block long, arrays binary").groupBy("block").applyInArrow(_sum_block, "term_id long, total_count long, doc_count long")
    # One row, so it may be broadcast.
    docs = F.broadcast(documents(rows))
    mark = F.when(F.col("doc_count") <= rare_docs, "rare").when(F.col("doc_count") >= F.lit(common_share) * F.col("docs"), "common")
    return words.join(sums, "term_id").crossJoin(docs).select("term", "total_count", "doc_count", mark.alias("mark"))
