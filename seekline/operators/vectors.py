"""Embedding and exact nearest-neighbour search for tables of queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings
from seekline.functions.text import text_or_empty
from seekline.sources.tables import page, upsert


def hash_embedder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sentence model: tokens are hashed to signed places, the sum has length 1."""
    word = re.compile(r"[a-z0-9]+")
    known: dict[str, tuple[int, float]] = {}

    def place(w: str) -> tuple[int, float]:
        got = known.get(w)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            h = hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()
            got = known[w] = int(h[:8], 16) % dimension, 1.0 if h[8] >= "8" else -1.0
        return got

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            for w in word.findall((text or "").lower()):
                at, sign = place(w)
                row[at] += sign
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).astype(np.float32)

    return embed


def embedding_text(s: Settings = DEFAULTS) -> Column:
    """Title, blank and content, nulls as empty, cut to the model's input length."""
    return F.substring(F.concat(text_or_empty("title"), F.lit(" "), text_or_empty("content")), 1, s.embed_chars)


def pending(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Documents without a vector yet."""
    return docs.join(embeddings.select("doc_id"), "doc_id", "left_anti")


def pending_page(docs: DataFrame, embeddings: DataFrame, size: int = DEFAULTS.embed_batch, after: int | None = None) -> DataFrame:
    """The next ``size`` documents without a vector, by identifier; stored ones drop out, so a run that was stopped goes on where it was."""
    return page(pending(docs, embeddings), "doc_id", size, after)


def store(embeddings: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table of vectors after an update: a document's new vector replaces the one it had."""
    return upsert(embeddings, fresh, "doc_id")


def embed(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], s: Settings = DEFAULTS) -> DataFrame:
    """``doc_id, vector``; ``make`` builds the model once per Python worker, texts go in batches of ``embed_batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), s.embed_batch):
                got = model(texts[i : i + s.embed_batch]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, s.embed_batch), pa.array(list(got), pa.list_(pa.float32()))], names=["doc_id", "vector"])

    return docs.select("doc_id", embedding_text(s).alias("text")).mapInArrow(run, "doc_id long, vector array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where a length is 0 or the dimensions differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((F.size(a) == F.size(b)) & (length(a) > 0) & (length(b) > 0), dot / (length(a) * length(b)))


def knn_one(vectors: DataFrame, query: list[float], k: int, id_col: str = "doc_id", column: str = "vector") -> DataFrame:
    """The ``k`` most similar rows to one vector: a scan with a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id_col), cosine(F.col(column), q).alias("similarity")).where("similarity is not null").orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


#: Bytes of query vectors that a task is sent at once; a larger set is searched in several scans.
SENT_BYTES = 64_000_000
#: Queries that a task multiplies with a batch of rows at once.
TOGETHER = 256


#: More than 32-bit products of unit vectors can be off.
SLACK = 1e-5


def _first(row: np.ndarray, name: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar entries of each row; on equal similarity the smaller name comes first."""
    order = np.lexsort((name, -sim, row))
    row, name, sim = row[order], name[order], sim[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
    return row[keep], name[keep], sim[keep]


class _Kept:
    """The best so far of up to TOGETHER queries, and the similarity that is needed to be among them."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.short, self.k = queries, queries.astype(np.float32), k
        self.best = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(queries), -np.inf)

    def add(self, x: np.ndarray, short: np.ndarray, names: np.ndarray) -> None:
        """Compare with rows: roughly in 32 bits, and exactly where that may be enough."""
        sims = self.short @ short.T
        least = self.least
        if sims.shape[1] > self.k and np.isinf(least).any():
            least = np.maximum(least, np.partition(sims, sims.shape[1] - self.k, axis=1)[:, sims.shape[1] - self.k])
        row, at = np.nonzero(sims >= (least - SLACK)[:, None])
        if not len(row):
            return
        exact = np.concatenate([np.einsum("ij,ij->i", self.q[row[i : i + 16384]], x[at[i : i + 16384]]) for i in range(0, len(row), 16384)])
        self.best = _first(*(np.concatenate(c) for c in zip(self.best, (row, names[at], np.round(exact, 12)))), self.k)
        n = np.bincount(self.best[0], minlength=len(self.q))
        last = np.cumsum(n) - 1
        self.least = np.where(n >= self.k, self.best[2][np.maximum(last, 0)], -np.inf)


def _scanner(sent, k: int):
    """Multiplies rows (id, vector) with all sent queries of the same dimension and keeps the best of each."""

    def run(batches):
        kept = {dim: [_Kept(q[i : i + TOGETHER], k) for i in range(0, len(q), TOGETHER)] for dim, (_, q) in sent.value.items()}
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1))
            for dim in kept:
                rows = batch.filter(pa.compute.equal(sizes, dim))
                x = np.asarray(rows.column(1).flatten(), np.float64).reshape(-1, dim)
                n = np.linalg.norm(x, axis=1)
                x, mine = x[n > 0] / n[n > 0][:, None], rows.column(0).to_numpy(zero_copy_only=False)[n > 0]
                short = x.astype(np.float32)
                for block in kept[dim] if len(x) else []:
                    block.add(x, short, mine)
        for dim, (ids, _) in sent.value.items():
            for b, block in enumerate(kept[dim]):
                row, name, sim = block.best
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.array(ids, np.int64)[row + b * TOGETHER]), "id": pa.array(name), "similarity": pa.array(sim)})

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "doc_id", column: str = "vector", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``query_id, <id_col>, similarity, rank``: exact search for a stated set of query vectors against all rows.

    Queries are sent in blocks of at most ``sent_bytes``, one scan of the rows
    for each block (64 MB are 20,000 queries of 384 entries); each task
    multiplies its rows with the block and keeps ``k`` a query, so what is
    shuffled is ``k`` rows a query and task, whatever the table's size.  Rows
    meet the queries of their own dimension; null and all-zero vectors take no
    part.  For every row as a query there is the index, not this.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(F.col(id_col).cast("long"), F.col(column).cast("array<float>")).where(F.col(column).isNotNull())
    out, held, size = None, {}, 0

    def scan():
        block = {}
        for dim, part in held.items():
            q = np.array([v for _, v in part], np.float64)
            block[dim] = ([i for i, _ in part], q / np.linalg.norm(q, axis=1, keepdims=True))
        return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(block), k), "query_id long, id long, similarity double")

    for r in queries.select("query_id", "vector").where("vector is not null").toLocalIterator():  # one block is held at a time
        if any(r["vector"]):
            held.setdefault(len(r["vector"]), []).append((r["query_id"], r["vector"]))
            size += 8 * len(r["vector"])
        if size >= sent_bytes:
            out = scan() if out is None else out.unionByName(scan())
            held, size = {}, 0
    if held:
        out = scan() if out is None else out.unionByName(scan())
    if out is None:
        return spark.createDataFrame([], f"query_id long, {id_col} {kind}, similarity double, rank int")
    at = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "similarity", "rank")


def lsh_index(vectors: DataFrame, id_col: str = "doc_id", column: str = "vector", tables: int = 6, width: float = 0.5):
    """An approximate index by random projections over unit vectors, and the vectors in its form; no index (None) where there is no vector."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = Normalizer(inputCol="raw", outputCol="features").transform(vectors.where(F.col(column).isNotNull()).select(id_col, array_to_vector(F.col(column).cast("array<double>")).alias("raw")))
    index = None if rows.isEmpty() else BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=7).fit(rows)
    return index, rows


def vector_literal(column: Column) -> Column:
    """The vector as text: ``[a,b,...]``."""
    return F.to_json(column)
