"""The most similar vectors for every vector (problem 1).

An inverted file of coarse centroids whose lists hold product-quantised
residuals.  Centroids and codebooks are fitted on a bounded sample; every
vector is indexed and every vector is a query.  A query goes to the lists of
its ``probes`` nearest centroids.  There, a table of the products of the
query's pieces with the codebooks gives each entry's approximate similarity as
a sum of table entries (asymmetric: the query isn't quantised), and the best
``rerank`` of each list are compared exactly.

Lists that lie close together form a *cell group*; a query is sent once to each
group it probes, not once per list.  A group of more than ``block`` vectors is
split by identifier into blocks, and the queries go to each; so no task holds
more than a block, however the vectors crowd.  Equal vectors are indexed once,
as the one of the smallest identifier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekline.operators import vectors
from seekline.plans.lineage import materialize


@dataclass(frozen=True)
class Settings:
    """Parameters of the index; ``sample`` bounds the vectors that centroids and codebooks are fitted on."""

    dim: int = 384
    k: int = 10
    per_list: int = 1000
    max_lists: int = 8192
    probes: int = 4
    pieces: int = 96
    codes: int = 128
    rerank: int = 96
    lists_per_group: int = 4
    block: int = 16384
    query_block: int = 32768
    sample: int = 65536
    sample_of_few: int = 32768
    seed: int = 7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    """Centroids by Lloyd's iteration; an empty one restarts at a random point."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        order, n = np.argsort(a, kind="stable"), np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        sums[n > 0] = np.add.reduceat(x[order], (np.cumsum(n) - n)[n > 0], axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid by Euclidean distance, in blocks."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)])


def list_count(total: int, s: Settings) -> int:
    return max(1, min(s.max_lists, total // s.per_list))


class Index:
    """Centroids, their groups, and the codebooks of the residuals' pieces."""

    def __init__(self, sample: np.ndarray, total: int, s: Settings):
        rng = np.random.default_rng(s.seed)
        lists = max(1, min(list_count(total, s), len(sample) // 4))
        self.s = s
        self.centroids = _kmeans(sample, lists, 8, rng, spherical=True)
        lists = len(self.centroids)
        # A group is about half a block: long lists stand alone, so that a query isn't sent to several blocks.
        groups = max(1, lists // max(1, min(s.lists_per_group, s.block * lists // (2 * max(1, total)))))
        self.group = _nearest(self.centroids, _kmeans(self.centroids, groups, 8, rng)).astype(np.int32)
        rest = sample - self.centroids[_nearest(sample, self.centroids)]
        width = -(-s.dim // s.pieces)
        self.cuts = [(i * width, min(s.dim, (i + 1) * width)) for i in range(-(-s.dim // width))]
        few = rest[: 32 * s.codes]
        self.books = [_kmeans(np.ascontiguousarray(few[:, lo:hi]), s.codes, 4, rng) for lo, hi in self.cuts]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.stack([_nearest(np.ascontiguousarray(rest[:, lo:hi]), b) for (lo, hi), b in zip(self.cuts, self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each piece, the products of its codebook with the queries' pieces: (codes, queries)."""
        return [b @ q[:, lo:hi].T for (lo, hi), b in zip(self.cuts, self.books)]


def usable_vectors(docs: DataFrame, column: str = "vector", dim: int = 384) -> DataFrame:
    """``id, vector`` of the rows whose vector has ``dim`` entries, none null or NaN, not all zero."""
    v = F.col(column)
    return docs.where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)).select(F.col("doc_id").alias("id"), v.cast("array<float>").alias("vector"))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _short(x: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit numbers, each scaled to its largest entry; only the direction is needed, to 1e-5."""
    return np.rint(x * (32767 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16)


def _raw(column, dim: int) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dim).astype(np.float32))


def _placed(ix: Index, batches):
    """Identifiers, unit vectors, own lists, and for each row the cell groups it asks with the lists probed there."""
    s = ix.s
    p = min(s.probes, len(ix.centroids))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(ids), 2048):
            x = _unit(_matrix(batch.column(1).slice(i, 2048), s.dim))
            own = _nearest(x, ix.centroids)
            probe = np.argpartition(-(x @ ix.centroids.T), p - 1, axis=1)[:, :p]
            yield ids[i : i + 2048], x, own, probe


def _crowd(index):
    """Members and askers of the cell groups, pre-aggregated."""

    def run(batches):
        ix: Index = index.value
        member, asking = np.zeros(ix.group.max() + 1, np.int64), np.zeros(ix.group.max() + 1, np.int64)
        for _, _, own, probe in _placed(ix, batches):
            member += np.bincount(ix.group[own], minlength=len(member))
            groups = np.sort(ix.group[probe], axis=1)
            first = np.concatenate([np.ones((len(groups), 1), bool), groups[:, 1:] != groups[:, :-1]], axis=1)
            asking += np.bincount(groups[first], minlength=len(asking))
        yield pa.RecordBatch.from_pydict({"group": pa.array(np.arange(len(member), dtype=np.int32)), "members": pa.array(member), "asking": pa.array(asking)})

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.itemsize * x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its size says, and 0, 1, ... within it."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _route(index, blocks: np.ndarray, turns: np.ndarray):
    """Rows (group, block, turn, member, id, list, probes, code, vector): one for each place where a vector is held or asks."""

    def run(batches):
        ix: Index = index.value
        for ids, x, own, probe in _placed(ix, batches):
            code, vector, h = _binary(ix.encode(x, own)), _binary(_short(x)), _mixed(ids)
            home = ix.group[own]
            held, turn = _counted(turns[home])
            groups = np.sort(ix.group[probe], axis=1)
            first = np.concatenate([np.ones((len(groups), 1), bool), groups[:, 1:] != groups[:, :-1]], axis=1)
            row, group = np.nonzero(first)[0], groups[first]
            asks, block = _counted(blocks[group])
            asker, asked = row[asks], group[asks]
            at = np.concatenate([held, asker])
            m, k = len(held), len(asker)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([home[held], asked]).astype(np.int32)),
                pa.array(np.concatenate([(h[held] % blocks[home[held]].astype(np.uint64)).astype(np.int32), block.astype(np.int32)])),
                pa.array(np.concatenate([turn.astype(np.int32), ((h[asker] >> np.uint64(32)) % turns[asked].astype(np.uint64)).astype(np.int32)])),
                pa.array(np.arange(m + k) < m),
                pa.array(ids[at], pa.int64()),
                pa.array(own[at].astype(np.int32)),
                pa.concat_arrays([pa.nulls(m, pa.binary()), _binary(probe.astype(np.int32)).take(pa.array(asker))]),
                pa.concat_arrays([code.take(pa.array(held)), pa.nulls(k, pa.binary())]),
                vector.take(pa.array(at)),
            ], names=["group", "block", "turn", "member", "id", "list", "probes", "code", "vector"])

    return run


def _parts(s: Settings, vectors: np.ndarray, mine: np.ndarray, queries: np.ndarray, who: np.ndarray):
    """A list's members with the queries that look at them: all, or, of a long list, the parts that are nearest to each query."""
    k = -(-len(mine) // s.per_list)
    if k <= s.probes:
        yield mine, who
        return
    rng = np.random.default_rng(s.seed)
    x = vectors[mine]
    few = x if len(x) <= 16 * k else x[rng.choice(len(x), 16 * k, replace=False)]
    centres = _kmeans(few, k, 6, rng, spherical=True)
    own = _nearest(x, centres)
    probe = np.concatenate([np.argpartition(-(queries[who[i : i + 4096]] @ centres.T), s.probes - 1, axis=1)[:, : s.probes] for i in range(0, len(who), 4096)])
    for c in range(len(centres)):
        part, asking = mine[own == c], who[(probe == c).any(axis=1)]
        if len(part) and len(asking):
            yield part, asking


def _scan(index):
    """The best of one block of a cell group for each of its queries: (id, neighbour, similarity)."""

    def run(key, table):
        ix: Index = index.value
        s = ix.s
        kind = np.array(table.column("member").to_pylist(), bool)
        members, asking = table.filter(pa.array(kind)), table.filter(pa.array(~kind))
        empty = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "similarity": pa.array([], pa.float32())})
        if not len(members) or not len(asking):
            return empty
        mid, mvec = members.column("id").to_numpy(), _raw(members.column("vector"), s.dim)
        mlist = members.column("list").to_numpy()
        codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(mid), -1)
        qid, qvec = asking.column("id").to_numpy(), _raw(asking.column("vector"), s.dim)
        probes = np.frombuffer(b"".join(asking.column("probes").to_pylist()), np.int32).reshape(len(qid), -1)
        here = ix.group[probes] == key[0].as_py()
        pair_q, pair_c = np.nonzero(here)[0], probes[here]
        found_q, found_m, found_s = [], [], []
        places = ((mlist == c).nonzero()[0] for c in np.unique(pair_c))
        for mine, who in (part for c, all_ in zip(np.unique(pair_c), places) if len(all_) for part in _parts(s, mvec, all_, qvec, pair_q[pair_c == c])):
            own_codes = np.ascontiguousarray(codes[mine].T)
            for i in range(0, len(who), 256):
                q = who[i : i + 256]
                x = qvec[q]
                take = min(s.rerank, len(mine))
                if take < len(mine):
                    tables = ix.tables(x)
                    near = np.zeros((len(mine), len(q)), np.float32)
                    for t, code in zip(tables, own_codes):
                        near += t[code]
                    pick = np.argpartition(-near, take - 1, axis=0)[:take].T
                else:
                    pick = np.broadcast_to(np.arange(len(mine)), (len(q), len(mine)))
                at = mine[pick]
                exact = np.matmul(mvec[at], x[:, :, None])[:, :, 0]
                exact = np.where(mid[at] == qid[q][:, None], -9.0, exact)
                if take > s.k:
                    best = np.argpartition(-exact, s.k - 1, axis=1)[:, : s.k]
                    at, exact = np.take_along_axis(at, best, 1), np.take_along_axis(exact, best, 1)
                found_q.append(np.repeat(q, at.shape[1]))
                found_m.append(at.ravel())
                found_s.append(exact.ravel())
        if not found_q:
            return empty
        q, m, sim = np.concatenate(found_q), np.concatenate(found_m), np.concatenate(found_s)
        ok = sim > -5
        q, m, sim = q[ok], m[ok], sim[ok]
        order = np.lexsort((mid[m], -sim, q))
        q, m, sim = q[order], m[order], sim[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < s.k
        return pa.table({"id": pa.array(qid[q[keep]]), "other": pa.array(mid[m[keep]]), "similarity": pa.array(sim[keep].astype(np.float32))})

    return run


def nearest_classes(rows: DataFrame, s: Settings) -> DataFrame:
    """``id, other, similarity, rank``: the ``k`` nearest others of each of the given distinct vectors."""
    spark = rows.sparkSession
    total = rows.count()
    wanted = min(s.sample, max(s.sample_of_few, 8 * list_count(total, s)))
    share = min(1.0, 1.2 * wanted / max(1, total))
    # A bounded sample, the same whenever it is drawn: the vectors of the least hashes of their identifiers.
    lot = F.xxhash64("id", F.lit(s.seed))
    picked = rows.where(F.pmod(lot, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.pmod(lot, F.lit(1 << 20)), "id").limit(wanted).select("vector").toArrow()
    if not len(picked):
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).cast("float").alias("similarity"), F.lit(1).alias("rank")).limit(0)
    index = spark.sparkContext.broadcast(Index(_unit(_matrix(picked.column("vector"), s.dim)), total, s))
    # One row a group, and at most max_lists / lists_per_group groups.
    crowd = rows.mapInArrow(_crowd(index), "group int, members long, asking long").groupBy("group").agg(F.sum("members").alias("members"), F.sum("asking").alias("asking")).collect()
    blocks, turns = np.ones(len(crowd), np.int64), np.ones(len(crowd), np.int64)
    for r in crowd:
        blocks[r["group"]] = max(1, -(-r["members"] // s.block))
        turns[r["group"]] = max(1, -(-r["asking"] // s.query_block))
    schema = "group int, block int, turn int, member boolean, id long, list int, probes binary, code binary, vector binary"
    placed = rows.mapInArrow(_route(index, blocks, turns), schema)
    found = placed.groupBy("group", "block", "turn").applyInArrow(_scan(index), "id long, other long, similarity float")
    # A row's best are found in several places; a list of one place is at most k long.
    packed = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), F.col("other").alias("other")))).alias("near"))
    return packed.select("id", F.posexplode(F.slice("near", 1, s.k)).alias("rank", "n")).select("id", F.col("n.other").alias("other"), (-F.col("n.far")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def nearest_neighbours(docs: DataFrame, s: Settings = Settings(), column: str = "vector") -> DataFrame:
    """``doc_id, neighbour, rank, similarity``: the ``k`` most similar others of each row with a usable vector.

    Nearness is the cosine; on equal similarity the smaller doc_id comes first.
    Rows with a null vector, another dimension, null or NaN entries or only
    zeros take no part.  Rows with equal vectors are each other's nearest.  An
    empty table, or a single usable row, gives no rows.
    """
    rows = usable_vectors(docs, column, s.dim).where("id is not null").withColumn("print", F.xxhash64("vector")).withColumn("other_print", F.xxhash64(F.reverse("vector"), F.lit(1)))
    keys = rows.select("id", "print", "other_print")  # 128 bits, so unequal vectors aren't taken for equal ones
    shared = materialize(keys.groupBy("print", "other_print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "equal")
    copies = materialize(keys.join(shared, ["print", "other_print"]).select("id", "rep"), "copies")
    distinct = rows.join(copies.where("id <> rep").select("id"), "id", "left_anti").select("id", "vector")
    near = materialize(nearest_classes(distinct, s), "near")
    # The k + 1 smallest identifiers of each set of equal vectors: bounded, ranked before they are gathered.
    first = _first_ids(copies, s.k + 1)
    wide = near.join(first.select(F.col("rep").alias("other"), "ids"), "other", "left").select("id", "rank", "similarity", F.coalesce("ids", F.array("other")).alias("ids"))
    lists = wide.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "similarity", "ids"))).alias("near"))
    outside = lists.select("id", F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(i.alias("other"), x["similarity"].alias("similarity"))))).alias("outside"))
    outside = outside.select("id", F.slice("outside", 1, s.k).alias("outside"))
    members = rows.select("id").join(copies, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("rep", "id").alias("id"))
    joined = members.join(outside, "id", "left").join(first.withColumnRenamed("rep", "id"), "id", "left")
    same = F.transform(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("other"), F.lit(1.0).cast("float").alias("similarity")))
    both = F.concat(same, F.coalesce("outside", F.array().cast("array<struct<other:bigint,similarity:float>>")))
    ranked = joined.select("doc_id", F.slice(F.filter(both, lambda x: x["other"] != F.col("doc_id")), 1, s.k).alias("all"))
    out = ranked.select("doc_id", F.posexplode("all").alias("at", "n"))
    return out.select("doc_id", F.col("n.other").alias("neighbour"), (F.col("at") + 1).alias("rank"), F.col("n.similarity").alias("similarity"))


def _first_ids(copies: DataFrame, most: int) -> DataFrame:
    """``rep, ids``: the ``most`` smallest identifiers of each set, salted so that a huge set is no single task's."""
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    part = salted.withColumn("at", F.row_number().over(Window.partitionBy("rep", "salt").orderBy("id"))).where(F.col("at") <= most)
    lists = part.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most 16 * most identifiers
    return lists.select("rep", F.slice("ids", 1, most).alias("ids"))


def neighbour_pairs(docs: DataFrame, s: Settings = Settings(), column: str = "vector") -> DataFrame:
    """``doc_a, doc_b`` (doc_a < doc_b) of which at least one is among the other's nearest."""
    near = nearest_neighbours(docs, s, column)
    return near.select(F.least("doc_id", "neighbour").alias("doc_a"), F.greatest("doc_id", "neighbour").alias("doc_b")).distinct()


def recall(docs: DataFrame, s: Settings = Settings(), column: str = "vector", every: int = 50) -> DataFrame:
    """``queries, pairs, found, recall``: of the exact nearest of every row whose identifier is divisible by ``every``, how many the index gives.

    The exact search compares these rows with all; a neighbour counts as found
    if one as similar is given, since equal similarity has no order here.
    """
    rows = usable_vectors(docs, column, s.dim).where("id is not null")
    exact = vectors.knn(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector"), rows.select(F.col("id").alias("doc_id"), "vector"), s.k + 1)
    exact = exact.where("query_id <> doc_id").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id"))).where(F.col("at") <= s.k)
    worst = exact.groupBy("query_id").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("n"))
    given = nearest_neighbours(docs, s, column).where(F.col("doc_id") % every == 0)
    hits = given.join(worst, given["doc_id"] == worst["query_id"]).where(F.col("similarity") >= F.col("worst") - 1e-4).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    got = worst.join(hits, "query_id", "left").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("pairs"), F.sum(F.least(F.coalesce("found", F.lit(0)), "n")).alias("found"))
    return got.withColumn("recall", F.round(F.col("found") / F.col("pairs"), 4))
