"""Adding up arrays of counters from any number of partitions.

A sketch is cut into chunks.  Every task of the first level streams the chunks
of a share of the partitions and holds one sum a chunk; the second level adds
the shares' sums.  No task ever holds the arrays of all partitions, and no
chunk is a single task's until few arrays of it are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.sources.tables import partitions

#: Shares that the partitions' arrays of a chunk are dealt to on the first level.
SHARES = 64


def chunks_of(array: np.ndarray, chunk: int) -> pa.RecordBatch:
    """A partition's flat array as rows (chunk, values) of ``chunk`` counters each, without chunks of zeros."""
    rows = array.reshape(-1, chunk)
    some = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_pydict({"chunk": pa.array(some.astype(np.int32)), "values": pa.array([rows[i].tobytes() for i in some], pa.binary())})


CHUNKS = "chunk int, values binary"


def _adder(dtype: np.dtype, wide: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer(), dtype)
                if chunk in sums:
                    sums[chunk] += x
                else:
                    sums[chunk] = x.astype(wide)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "values": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    return run


def added(parts: DataFrame, dtype, wide) -> DataFrame:
    """``chunk, values``: the sums over all partitions' rows (chunk, values), whose counters have the type ``dtype``; sums have the type ``wide``.

    There are as many rows as a sketch has chunks, a bound that doesn't depend on the data.
    """
    dtype, wide = np.dtype(dtype), np.dtype(wide)
    width = partitions(parts.sparkSession)
    dealt = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).repartition(width, "chunk", "share").select("chunk", "values")
    return dealt.mapInArrow(_adder(dtype, wide), CHUNKS).repartition(width, "chunk").mapInArrow(_adder(wide, wide), CHUNKS)


def gathered(sums: DataFrame, size: int, wide) -> np.ndarray:
    """The whole array on the driver: ``size`` counters, a fixed number."""
    out = np.zeros(size, wide)
    for r in sums.collect():
        x = np.frombuffer(r["values"], wide)
        out[r["chunk"] * len(x) : (r["chunk"] + 1) * len(x)] = x
    return out
