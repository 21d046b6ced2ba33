"""Near-duplicate records by a prefix-tree join (problem 3).

A record is the set of its ``n``-word sequences, ordered by one global order,
rare sequences first.  Records whose sets are equal form a class that is joined
once.  Two sets of similarity ``t`` share a sequence among the first
``size - ceil(t * size) + 1`` of either (and a ``d``-th shared one among the
first ``... + d``), so the tree of shared sequences is walked from its root:

* a node is the list of records that share a path of sequences in order;
  a record leaves the node when its size or its remaining length no longer
  allows the needed overlap with any other;
* a node of up to ``NODE`` records proposes its pairs; a larger one is split by
  the next shared sequence, and after ``max_depth`` levels into blocks that
  are joined two by two, so no task ever holds a whole hot node;
* a pair stays only if, of the sequences in both prefixes, it shares enough
  that the rest can still reach the overlap (sequences of large nodes, which
  aren't counted, are taken as shared);
* proposed pairs are checked exactly: the partners of a record are laid out as
  a prefix tree, partial overlaps are shared along common prefixes, and a
  subtree is left when its remaining length can't reach the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.llm.sums import CHUNKS, added, chunks_of, gathered
from seekline.llm.words import WordHashes, grams, words
from seekline.plans.lineage import materialize
from seekline.sources.tables import partitions, spread

#: Buckets of the document-frequency sketch that fixes the global order: 16 MB whatever the input.
SKETCH = 1 << 22
SKETCH_CHUNK = 1 << 17
#: Bytes of a stored sequence hash; equal hashes of different sequences within a pair are as likely as 1 in 10 million.
WIDE = 5
#: Records of a node that are compared in one place.
NODE = 256
#: Members of a class of equal sets whose pairs are written out; beyond it copies to the letter are linked to the first of them.
EXPAND = 64


def _needed(t: float, n):
    """Least number of shared sequences a set of size n has with any set of similarity t."""
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


_SHIFT = np.uint64(8 * WIDE - 22)


def _pack(g: np.ndarray) -> bytes:
    return g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDE].tobytes()


def _unpack(raw) -> np.ndarray:
    b = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, WIDE)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :WIDE] = b
    return out.view("<u8").ravel()


def _sets(batch: pa.RecordBatch, n: int, hasher: WordHashes) -> Iterator[tuple[int, np.ndarray, int]]:
    for doc, title, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        if content is None or doc is None:
            continue
        g = np.unique(grams(hasher(words(f"{title or ''} {content}")), n) >> np.uint64(64 - 8 * WIDE))
        if len(g):
            yield doc, g, xxhash.xxh3_64_intdigest(f"{title or ''}\0{content}") >> 1


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, some = WordHashes(), np.zeros(SKETCH, np.int32), False
        for batch in batches:
            for _, g, _ in _sets(batch, n, hasher):
                some = True
                np.add.at(counts, (g >> _SHIFT).astype(np.int64), 1)
        if some:
            yield chunks_of(np.minimum(counts, 65535).astype(np.uint16), SKETCH_CHUNK)

    return run


def _frequency_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Document frequencies by hash bucket over all records: SKETCH counters, a proven bound for the driver and the broadcast."""
    return np.minimum(gathered(added(docs.mapInArrow(_sketcher(n), CHUNKS), np.uint16, np.int64), SKETCH, np.int64), 2**31 - 1).astype(np.int32)


def _set_builder(n: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, df = WordHashes(), sketch.value
        for batch in batches:
            ids, sizes, prints, seqs, texts = [], [], [], [], []
            for doc, g, text in _sets(batch, n, hasher):
                g = g[np.lexsort((g, df[(g >> _SHIFT).astype(np.int64)]))]
                with np.errstate(over="ignore"):
                    mixed = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    prints.append(int((mixed ^ (mixed >> np.uint64(27))).sum(dtype=np.uint64).view(np.int64)))
                ids.append(doc)
                sizes.append(len(g))
                seqs.append(_pack(g))
                texts.append(text)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "print": pa.array(prints, pa.int64()), "size": pa.array(sizes, pa.int32()), "seqs": pa.array(seqs, pa.binary()), "text": pa.array(texts, pa.int64())})

    return run


def _roots(t: float):
    """Rows (node, doc, size, place) for the sequences of each record's prefix."""

    def run(batches):
        for batch in batches:
            node, doc, size, place = [], [], [], []
            for d, s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                p = s - int(_needed(t, s)) + 1
                node.append(_unpack(raw)[:p].astype(np.int64))
                doc.append(np.full(p, d, np.int64))
                size.append(np.full(p, s, np.int32))
                place.append(np.arange(p, dtype=np.int32))
            if node:
                yield pa.RecordBatch.from_pydict({"node": np.concatenate(node), "doc": np.concatenate(doc), "size": np.concatenate(size), "place": np.concatenate(place)})

    return run


def _propose(t: float, depth: int, doc, size, place, other=None):
    """Pairs of one node; ``other`` marks where a second block begins."""
    n = len(doc)
    if other is None:
        a, b = np.triu_indices(n, 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.arange(other), np.arange(other, n), indexing="ij"))
    return _allowed(t, depth, doc, size, place, a, b)


def _propose_many(t: float, depth: int, rows, starts, sizes):
    """Pairs of many small nodes of ``rows``, those of one size at a time."""
    out = []
    for k in np.unique(sizes).tolist():
        i, j = np.triu_indices(k, 1)
        at = starts[sizes == k]
        step = max(1, 1_000_000 // len(i))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step, None]
            out.append(_allowed(t, depth, rows[:, 1], rows[:, 2], rows[:, 3], (part + i).ravel(), (part + j).ravel()))
    return out


def _allowed(t: float, depth: int, doc, size, place, a, b):
    """The pairs (a, b) of rows that sizes and, below the first level, remaining lengths allow.

    Also gives how far what may follow here exceeds the needed overlap, and how
    many sequences the prefixes must share at least.
    """
    sa, sb = size[a].astype(np.int64), size[b].astype(np.int64)
    need = np.ceil(t / (1 + t) * (sa + sb) - 1e-9).astype(np.int64)
    reach = depth - 1 + np.minimum(sa - place[a], sb - place[b]) - need
    ok = (np.minimum(sa, sb) >= _needed(t, np.maximum(sa, sb))) & (doc[a] != doc[b])
    if depth > 1:
        ok &= reach >= 0
    least = need - np.maximum(_needed(t, sa), _needed(t, sb)) + 1
    a, b = a[ok], b[ok]
    return np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b]), reach[ok], least[ok]


_NODES = "a long, b long, reach int, least int, node long, doc long, size int, place int, block int"


def _nodes_out(pairs, rows, block):
    """Pairs, then rows of large nodes, in one batch with nulls in the others' columns."""
    k, m = len(pairs[0]), len(block)
    left = [(x, kind) for x, kind in zip(pairs, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    right = [(x, kind) for x, kind in zip((*rows.T, block), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    columns = [pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)]) for x, kind in left] + [pa.concat_arrays([pa.nulls(k, kind), pa.array(x, kind)]) for x, kind in right]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "reach", "least", "node", "doc", "size", "place", "block"])


def _walk(t: float, depth: int):
    """Over rows sorted by node: pairs of small nodes; the rows of larger ones as they are, with the block they fall in."""

    def close(kept, held, given, pairs, big, blocks):
        if given and held:
            big.append(np.concatenate(kept))
            blocks.append(np.full(held, given, np.int64))
        elif held > 1:
            g = np.concatenate(kept)
            pairs.append(_propose(t, depth, g[:, 1], g[:, 2], g[:, 3]))

    def emit(pairs, big, blocks):
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return _nodes_out([cat([p[i] for p in pairs]) for i in range(4)], np.concatenate(big) if big else np.zeros((0, 4), np.int64), cat(blocks))

    def run(batches):
        kept: list[np.ndarray] = []  # the node at hand: [node, doc, size, place] by row
        held, current, given = 0, None, 0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if not len(cols[0]):
                continue
            rows = np.stack(cols, axis=1)
            cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            ends = np.r_[cuts[1:], len(rows)]
            big, blocks = [], []
            # Nodes that lie whole within the batch and are small are paired together; the others one by one.
            inner = np.zeros(len(cuts), bool)
            inner[1:-1] = ends[1:-1] - cuts[1:-1] <= NODE
            some = inner & (ends - cuts > 1)
            pairs = _propose_many(t, depth, rows, cuts[some], (ends - cuts)[some])
            for i in np.flatnonzero(~inner):
                start, end = cuts[i], ends[i]
                if current is not None and rows[start, 0] != current:
                    close(kept, held, given, pairs, big, blocks)
                    kept, held, given = [], 0, 0
                current = rows[start, 0]
                kept.append(rows[start:end])
                held += end - start
                while held > NODE:
                    whole = np.concatenate(kept)
                    big.append(whole[:NODE])
                    blocks.append(np.full(NODE, given, np.int64))
                    given += 1
                    kept, held = [whole[NODE:]], held - NODE
            yield emit(pairs, big, blocks)
        pairs, big, blocks = [], [], []
        close(kept, held, given, pairs, big, blocks)
        yield emit(pairs, big, blocks)

    return run


def _descend(t: float, depth: int):
    """Children of large nodes: rows keyed by the path and the next sequence of the record within its longer prefix."""

    def run(batches):
        for batch in batches:
            node, doc, size, place = [], [], [], []
            for nd, d, s, p, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                end = s - int(_needed(t, s)) + depth
                seqs = _unpack(raw)[p + 1 : end]
                with np.errstate(over="ignore"):
                    child = (seqs ^ np.uint64(nd & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
                    child ^= child >> np.uint64(32)
                    child *= np.uint64(0xD6E8FEB86659FD93)
                node.append(child.view(np.int64))
                doc.append(np.full(len(seqs), d, np.int64))
                size.append(np.full(len(seqs), s, np.int32))
                place.append(np.arange(p + 1, p + 1 + len(seqs), dtype=np.int32))
            if node:
                yield pa.RecordBatch.from_pydict({"node": np.concatenate(node), "doc": np.concatenate(doc), "size": np.concatenate(size), "place": np.concatenate(place)})

    return run


def _block_pairs(t: float, depth: int):
    def run(key, table):
        first, second = (k.as_py() for k in key[1:])
        doc, size, place, block = (table.column(c).to_numpy() for c in ("doc", "size", "place", "block"))
        order = np.argsort(block, kind="stable")
        doc, size, place, block = doc[order], size[order], place[order], block[order]
        if first == second:
            a, b, _, _ = _propose(t, depth, doc, size, place)
        else:
            a, b, _, _ = _propose(t, depth, doc, size, place, int((block == first).sum()))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _check(t: float):
    """Exact check over rows sorted by record a: its partners b are walked as a prefix tree."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sa, sb = batch.column(2), batch.column(3)
            if not len(a):
                continue
            cuts = [*np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)]
            oa, ob, oj = [], [], []
            for lo, hi in zip(cuts, cuts[1:]):
                probe = np.sort(_unpack(sa[lo]))
                sets = sorted(((_unpack(sb[i]), int(b[i])) for i in range(lo, hi)), key=lambda x: x[0].tobytes())
                path, partial, dead = np.zeros(0, np.uint64), np.zeros(1, np.int64), -1
                for seq, other in sets:
                    m = min(len(path), len(seq))
                    differ = np.flatnonzero(path[:m] != seq[:m])
                    shared = int(differ[0]) if len(differ) else m
                    if 0 <= dead <= shared:
                        # The subtree below ``dead`` was left; sizes are bounded there, so the need is at least the probe's own.
                        continue
                    rest = seq[shared:]
                    at = np.searchsorted(probe, rest)
                    hit = (at < len(probe)) & (probe[np.minimum(at, len(probe) - 1)] == rest)
                    partial = np.concatenate([partial[: shared + 1], partial[shared] + np.cumsum(hit)])
                    path = seq
                    over = int(partial[len(seq)])
                    # Below depth k, at most k - partial[k] sequences of the path are no longer among the probe's.
                    missed = np.arange(len(partial)) - partial
                    lost = np.flatnonzero(missed > (1 - t) / t * len(probe) + 1e-9)
                    dead = int(lost[0]) if len(lost) else -1
                    union = len(probe) + len(seq) - over
                    if over >= t * union - 1e-9:
                        oa.append(int(a[lo]))
                        ob.append(other)
                        oj.append(over / union)
            yield pa.RecordBatch.from_pydict({"a": pa.array(oa, pa.int64()), "b": pa.array(ob, pa.int64()), "similarity": pa.array(oj, pa.float64())})

    return run


def similar_sets(docs: DataFrame, n: int = 5, t: float = 0.8, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and the pairs of classes of similarity ``t`` or more.

    ``docs`` has (doc_id, title, content).  Gives ``(doc_id, rep, text)`` for every
    record with at least ``n`` words, ``rep`` being the smallest doc_id with an
    equal set and ``text`` a hash of title and content, and ``(a, b, similarity)`` of representatives, ``a < b``.
    Records with null content or fewer than ``n`` words are in neither.
    """
    spark = docs.sparkSession
    width = partitions(spark)
    docs = spread(docs.select("doc_id", "title", "content"))
    sketch = spark.sparkContext.broadcast(_frequency_sketch(docs, n))
    every = materialize(docs.mapInArrow(_set_builder(n, sketch), "doc_id long, print long, size int, seqs binary, text long"), "sets")
    classes = every.groupBy("print", "size").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    copies = classes.where("members > 1")
    member = every.select("doc_id", "print", "size", "text").join(copies, ["print", "size"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "text")
    member = materialize(member, "classes")
    # One record of each class takes part; those left out are only the copies, so this side is small where copies are few.
    sets = every.join(member.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti").select("doc_id", "size", "seqs")

    rows = sets.mapInArrow(_roots(t), "node long, doc long, size int, place int")
    pairs = None
    for depth in range(1, max_depth + 1):
        walked = rows.repartition(width, "node").sortWithinPartitions("node").mapInArrow(_walk(t, depth), _NODES)
        walked = materialize(walked, "nodes")
        large = walked.where("node is not null")
        crowded = not large.isEmpty()
        if depth == 1:
            shared = walked.where("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach"), F.first("least").alias("least")).where("reach >= 0")
            if crowded:
                hot = large.groupBy("doc").agg(F.count(F.lit(1)).alias("hot"))
                shared = shared.join(hot.select(F.col("doc").alias("a"), F.col("hot").alias("ha")), "a", "left").join(hot.select(F.col("doc").alias("b"), F.col("hot").alias("hb")), "b", "left")
                shared = shared.where(F.col("n") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.col("least"))
            else:
                shared = shared.where("n >= least")
            pairs = shared.select("a", "b")
        else:
            pairs = pairs.unionByName(walked.where("a is not null").select("a", "b"))
        if not crowded or depth == max_depth:
            break
        step = large.join(sets.select(F.col("doc_id").alias("doc"), "seqs"), "doc").select("node", "doc", "size", "place", "seqs")
        rows = step.mapInArrow(_descend(t, depth + 1), "node long, doc long, size int, place int")
    if crowded:
        blocks = large.groupBy("node").agg(F.max("block").alias("last"))
        sent = large.join(blocks, "node").select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        sent = sent.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "size", "place", "block")
        pairs = pairs.unionByName(sent.groupBy("node", "i", "j").applyInArrow(_block_pairs(t, max_depth), "a long, b long"))
    pairs = materialize(pairs.distinct(), "proposed")
    # Only sets of records in some pair are sent on; Spark itself broadcasts the identifiers where they are few.
    asked = sets.select("doc_id", "seqs").join(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    left = pairs.join(asked.select(F.col("doc_id").alias("a"), F.col("seqs").alias("sa")), "a")
    both = left.join(asked.select(F.col("doc_id").alias("b"), F.col("seqs").alias("sb")), "b")
    laid = both.select("a", "b", "sa", "sb").repartition(width, "a", F.pmod("b", F.lit(16))).sortWithinPartitions("a")
    return member, materialize(laid.mapInArrow(_check(t), "a long, b long, similarity double"), "pairs")


def duplicate_pairs(docs: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """``doc_a, doc_b`` (doc_a < doc_b) of similarity ``t`` or more.

    Records of equal sets are written out as all pairs up to ``EXPAND`` of
    them.  Of a larger class, records of the very same title and content are
    given as the first of them paired with each other one; records whose texts
    differ, though their sets don't, are written out as all pairs of these
    firsts, in salted joins, and so are their links to other classes.
    """
    member, similar = similar_sets(docs, n, t)
    sizes = member.groupBy("rep").agg(F.count(F.lit(1)).alias("members"))
    many = sizes.where("members > 1")
    inside = member.join(many, "rep")
    small, large = inside.where(F.col("members") <= EXPAND), inside.where(F.col("members") > EXPAND)
    one = small.groupBy("rep").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # at most EXPAND identifiers
    own = one.select(F.explode("ids").alias("doc_a"), "ids").select("doc_a", F.explode("ids").alias("doc_b")).where("doc_a < doc_b")
    firsts = materialize(large.groupBy("rep", "text").agg(F.min("doc_id").alias("first")), "texts")
    star = large.join(firsts, ["rep", "text"]).where("doc_id <> first").select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    salts = 16
    left = firsts.select("rep", F.pmod(F.xxhash64("first"), F.lit(salts)).cast("int").alias("salt"), F.col("first").alias("doc_a"))
    right = firsts.select("rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("first").alias("doc_b"))
    texts = left.join(right, ["rep", "salt"]).where("doc_a < doc_b").select("doc_a", "doc_b")
    ids = one.select("rep", "ids")
    across = similar.select("a", "b")
    for side in ("a", "b"):
        across = across.join(ids.select(F.col("rep").alias(side), F.col("ids").alias(f"i{side}")), side, "left").join(firsts.select(F.col("rep").alias(side), F.col("first").alias(f"f{side}")), side, "left")
    every = lambda side: F.coalesce(f"i{side}", F.array(F.coalesce(f"f{side}", side)))
    across = across.select(F.explode(every("a")).alias("x"), every("b").alias("ys")).select("x", F.explode("ys").alias("y"))
    return own.unionByName(star).unionByName(texts).unionByName(across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")))


def duplicate_groups(docs: DataFrame, n: int = 5, t: float = 0.8, max_rounds: int = 40) -> DataFrame:
    """``doc_id, group_id, links``: the connected group of each record (its smallest doc_id) and its number of links to other classes.

    Records with null content or fewer than ``n`` words have no group and no
    row.  Groups are found by passing the smallest identifier along links and
    pointers until nothing changes.
    """
    member, similar = similar_sets(docs, n, t)
    edges = materialize(similar.select("a", "b").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialize(edges.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(max_rounds):
        near = edges.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = step.join(label.select(F.col("id").alias("to"), F.col("label").alias("further")), "to").select("id", F.least("to", "further").alias("label"), "was")
        done = materialize(jump, "labels")
        label = done.select("id", "label")
        if done.where("label <> was").isEmpty():
            break
    else:
        raise RuntimeError("groups did not settle")
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    named = member.join(label.withColumnRenamed("id", "rep"), "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left")
    return named.select("doc_id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
