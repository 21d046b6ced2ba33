"""Approximate nearest-neighbour search for single queries and tables of queries over a stored index.

Vectors lie in one folder for each list, a list being what is nearest to one
centroid.  A query is compared exactly with the members of its nearest lists
only; a single query reads just their folders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekline.operators.vectors import cosine, knn_one

#: Most vectors that centroids are fitted on.
SAMPLE = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.bincount(own, minlength=len(c))[:, None] > 0, _unit(sums), c)
    return c.astype(np.float32)


class StoredIndex:
    """Vectors (id, vector) of one dimension below ``path``, in lists.

    ``lists`` is by default the square root of their number, 4,096 at most, so
    the centroids are a bounded broadcast; null vectors and those of another
    dimension or all zero are left out.
    """

    def __init__(self, vectors: DataFrame, path: str, dimension: int, id_col: str = "doc_id", column: str = "vector", lists: int | None = None):
        self.spark, self.id_col = vectors.sparkSession, id_col
        v = F.col(column)
        rows = vectors.where((F.size(v) == dimension) & F.exists(v, lambda x: x != 0)).select(id_col, v.cast("array<float>").alias("vector"))
        total = rows.count()
        share = 1.2 * SAMPLE / max(total, 1)
        lot = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
        sample = rows.where(lot < int(min(1.0, share) * (1 << 20)) + 1).orderBy(lot, id_col).limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
        x = _unit(np.asarray(sample.flatten(), np.float32).reshape(-1, dimension)) if total else np.zeros((1, dimension), np.float32)
        self.centroids = _centroids(x, lists or max(1, min(4096, int(total**0.5))))
        sent = self.spark.sparkContext.broadcast(self.centroids)

        def assign(batches):
            for b in batches:
                x = np.asarray(b.column(1).flatten(), np.float32).reshape(-1, dimension)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ sent.value.T).argmax(axis=1).astype(np.int32))], names=[*b.schema.names, "list"])

        kind = dict(rows.dtypes)[id_col]
        rows.mapInArrow(assign, f"{id_col} {kind}, vector array<float>, list int").repartition("list").write.mode("overwrite").partitionBy("list").parquet(path)
        self.table = self.spark.read.schema(f"{id_col} {kind}, vector array<float>, list int").parquet(path)

    def _nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        p = min(probes, len(self.centroids))
        return np.argpartition(-(x @ self.centroids.T), p - 1, axis=-1)[..., :p]

    def search_one(self, vector: list[float], k: int, probes: int = 8) -> DataFrame:
        """``<id>, similarity`` of about the ``k`` most similar rows; only the folders of ``probes`` lists are read."""
        lists = self._nearest(np.array(vector, np.float32), probes).tolist()
        return knn_one(self.table.where(F.col("list").isin(lists)), vector, k, self.id_col)

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """``query_id, <id>, similarity, rank`` for a table (query_id, vector): queries are joined with the members of their lists."""
        sent = self.spark.sparkContext.broadcast(self.centroids)
        dim = self.centroids.shape[1]

        def route(batches):
            for b in batches:
                x = np.asarray(b.column(1).flatten(), np.float32).reshape(-1, dim)
                p = min(probes, len(sent.value))
                lists = np.argpartition(-(x @ sent.value.T), p - 1, axis=1)[:, :p]
                at = pa.array(np.repeat(np.arange(len(x)), p))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lists.ravel().astype(np.int32))], names=["query_id", "asked", "list"])

        fits = queries.where(F.size("vector") == dim).select("query_id", F.col("vector").cast("array<float>"))
        routed = fits.mapInArrow(route, f"query_id {dict(queries.dtypes)['query_id']}, asked array<float>, list int")
        scored = routed.join(self.table, "list").select("query_id", self.id_col, cosine(F.col("asked"), F.col("vector")).alias("similarity")).where("similarity is not null")
        at = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc(self.id_col))
        return scored.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)
