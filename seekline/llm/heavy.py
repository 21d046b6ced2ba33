"""Most frequent items by combinatorial group testing (problem 7).

Every partition keeps ``depth`` rows of ``width`` buckets; a bucket holds the
number of its items and, for each of the 64 bits of the item's identifier, the
number of items that have this bit set: ``depth * width * 65`` counters,
whatever the number of rows or of distinct values.  Sketches add up, so
partitions are summed counter by counter, on two levels.  In a bucket where one item makes up
more than half, each bit counter tells that item's bit, and the identifier is
read off directly.  Decoded identifiers are then counted exactly in a second
scan, so the reported counts are exact and a wrongly decoded one drops out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekline.llm.sums import CHUNKS, added, chunks_of

BITS = 64
#: Buckets summed and decoded together.
CHUNK = 128
#: A partition gives its counters out before one of them could pass 32 bits.
FULL = 1 << 30


def clean_query(text: Column) -> Column:
    """Lower case, outer blanks cut, runs of blanks made one; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, so that bucket choice is independent of the decoded bits."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def _sketch(depth: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((depth, width, BITS + 1), np.int64)
        seen = False
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(ids):
                continue
            seen = True
            ids, n = np.unique(ids, return_counts=True)
            bits = ((ids[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
            rows = np.concatenate([n[:, None], bits * n[:, None]], axis=1)
            for d in range(depth):
                bucket = (_mix(ids, d + 1) % np.uint64(width)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                b = bucket[order]
                first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                counts[d, b[first]] += np.add.reduceat(rows[order], first, axis=0)
            if counts[:, :, 0].max() > FULL:
                yield chunks_of(counts.astype(np.int32).ravel(), CHUNK * (BITS + 1))
                counts[:], seen = 0, False
        if seen:
            yield chunks_of(counts.astype(np.int32).ravel(), CHUNK * (BITS + 1))

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, BITS + 1)
        n, bits = total[:, :1], total[:, 1:]
        # A majority item leaves every bit counter clearly on one side of one half.
        clear = (n[:, 0] > 0) & (np.abs(2 * bits - n) > 0).all(axis=1)
        ids = (((2 * bits > n).astype(np.uint64)) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[clear].view(np.int64)), "bucket_total": pa.array(n[clear, 0])})


def sketch_candidates(items: DataFrame, id_col: str, depth: int = 4, width: int = 4096) -> DataFrame:
    """Identifiers decoded from the summed sketch, at most ``depth * width``, with an upper bound of their counts."""
    parts = items.select(id_col).mapInArrow(_sketch(depth, width), CHUNKS)
    return added(parts, np.int32, np.int64).mapInArrow(_decode, "id long, bucket_total long").groupBy("id").agg(F.min("bucket_total").alias("upper_bound"))


def frequent_items(df: DataFrame, column: str, share: float, depth: int = 4, width: int = 4096) -> DataFrame:
    """Values of ``column`` (cleaned text) in at least ``share`` of the rows whose text is not blank.

    Returns ``item``, ``approx_count`` (the sketch's upper bound) and
    ``exact_count``.  Null and blank texts are no items and don't count in the
    total; an empty table gives no rows.  Memory is bounded by the sketch:
    ``depth * width`` buckets, of which a bucket without the item holds on
    average ``rows / width``, far below ``share * rows`` while ``width`` is
    much larger than ``1 / share``.
    """
    if width < 4 / share:
        raise ValueError("width must be at least 4 / share")
    items = df.select(clean_query(F.col(column)).alias("item")).where("item <> ''").withColumn("id", F.xxhash64("item"))
    # At most depth * width rows: a proven bound, so this side may be broadcast.
    found = F.broadcast(sketch_candidates(items, "id", depth, width))
    counted = items.join(found, "id").groupBy("item").agg(F.count(F.lit(1)).alias("exact_count"), F.first("upper_bound").alias("approx_count"))
    total = F.broadcast(items.agg(F.count(F.lit(1)).alias("total")))
    return counted.crossJoin(total).where(F.col("exact_count") >= F.lit(share) * F.col("total")).select("item", "approx_count", "exact_count")
