"""Test passages in training text by suffix arrays (problem 9).

Each batch of training records is a shard.  Its words become the numbers they
have in the test items' vocabulary.  Stretches in which no match can lie, since
their neighbouring words stand together in no test item, are cut out, and a
suffix array is built over all suffixes of the rest, sorted over their whole
length up to the longest item.  Every suffix of every test item is
binary-searched in it; each place found is extended to its longest verbatim
match.  A record leaks an item when a match is ``run`` words or longer, or when
the whole item stands in it with at most ``share`` of its words changed,
inserted or left out, which is settled by alignment.  An item with ``k`` changes
allowed keeps a verbatim piece of ``ceil((length - k) / (k + 1))`` words, so
searching for ``min`` of that and ``run`` words loses no leak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.llm.words import words
from seekline.sources.tables import spread

#: Largest test set that is sent to every task: characters of all items together.
MAX_TEST_CHARS = 64_000_000


def seed_length(length: int, run: int, share: float) -> int:
    """Words of the longest verbatim piece that an item of this length surely keeps."""
    k = int(length * share + 1e-9)
    return max(1, min(run, -(-(length - k) // (k + 1))))


class TestSet:
    """The test items as numbers, with every suffix of every item that is long enough to be searched."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], run: int, share: float):
        self.run, self.share = run, share
        self.ids, texts = [], []
        for i, text in items:
            w = words(text)
            if w:
                self.ids.append(i)
                texts.append(w)
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        self.tokens = [np.array([self.vocabulary[w] for w in t], np.int32) for t in texts]
        self.allowed = [int(len(t) * share + 1e-9) for t in texts]
        seeds = [seed_length(len(t), run, share) for t in texts]
        #: Words that every searched match has at least.
        self.seed = min(seeds, default=1)
        flat, owner, at = [], [], []
        for n, t in enumerate(self.tokens):
            flat.append(np.concatenate([t, np.zeros(1, np.int32)]))
            owner.append(np.full(len(t) + 1, n, np.int32))
            at.append(np.arange(len(t) + 1, dtype=np.int32))
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.at = np.concatenate(at) if at else np.zeros(0, np.int32)
        size = len(self.vocabulary) + 1
        bits = np.zeros((size * size + 7) // 8 if size <= 20_000 else 0, np.uint8)
        pairs = self.flat[:-1].astype(np.int64) * size + self.flat[1:] if len(self.flat) else np.zeros(0, np.int64)
        self.pairs = np.unique(pairs[(self.flat[:-1] > 0) & (self.flat[1:] > 0)]) if len(pairs) else pairs
        if len(bits):
            np.bitwise_or.at(bits, self.pairs >> 3, (1 << (self.pairs & 7)).astype(np.uint8))
        self.bits, self.size = bits, size

    def has_pair(self, pair: np.ndarray) -> np.ndarray:
        if len(self.bits):
            return (self.bits[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 > 0
        at = np.minimum(np.searchsorted(self.pairs, pair), max(0, len(self.pairs) - 1))
        return self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)


def matching_runs(shard: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of the shard in which a match can lie, one after the other with a 0 behind each, and where each word stands in the shard.

    A match has at least ``tests.seed`` words, and every two neighbours in it
    stand together in some test item; what is in no such stretch can't match.
    """
    d = tests.seed
    kept = np.zeros(len(shard) + 1, np.int64)
    if d >= 2 and len(shard) >= d:
        fits = (shard[:-1] > 0) & (shard[1:] > 0)
        fits[fits] = tests.has_pair(shard[:-1][fits].astype(np.int64) * tests.size + shard[1:][fits])
        whole = np.concatenate([[0], np.cumsum(fits)])
        starts = np.flatnonzero(whole[d - 1 :] - whole[: len(whole) - d + 1] == d - 1)
        np.add.at(kept, starts, 1)
        np.add.at(kept, starts + d, -1)
    elif d == 1:
        kept[:-1] = np.diff(np.concatenate([[0], shard > 0]))
    inside = np.cumsum(kept)[:-1] > 0
    at = np.flatnonzero(inside | np.concatenate([[False], inside[:-1]]))  # each stretch, and the place behind it
    return np.where(inside[at], shard[at], 0), at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text`` in the order of the suffixes that begin there, by doubling the length that is sorted until it is ``depth`` or no two are equal."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth and len(text) and rank.max() + 1 < len(text):
        behind = np.zeros(len(text), np.int64)
        behind[: len(text) - k] = rank[k:] + 1
        rank = np.unique(rank * (len(text) + 1) + behind, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


def _bound(text: np.ndarray, array: np.ndarray, tests: np.ndarray, at: np.ndarray, d: int, above: bool) -> np.ndarray:
    """For each test suffix, by binary search, how many suffixes of the text lie below it over its first ``d`` words (or not above it)."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(array), np.int64)
    wanted = tests[at[:, None] + np.arange(d)]
    text = np.concatenate([text, np.zeros(d, text.dtype)])
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        here, there = text[array[mid][:, None] + np.arange(d)], wanted[open_]
        first = (here != there).argmax(axis=1)
        rows = np.arange(len(open_))
        x, y = here[rows, first], there[rows, first]
        up = (x < y) | (above & (x == y))
        lo[open_] = np.where(up, mid + 1, lo[open_])
        hi[open_] = np.where(up, hi[open_], mid)
    return lo


#: Matches that are looked at together; more are taken in turns.
TOGETHER = 1 << 20


def longest_matches(shard: np.ndarray, tests: TestSet) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the shard, place in the tests, length) of the maximal verbatim matches of at least ``tests.seed`` words, at most TOGETHER at a time."""
    d = tests.seed
    if len(shard) < d or not len(tests.flat):
        return
    text, origin = matching_runs(shard, tests)
    if not len(text):
        return
    array = suffix_array(text, max(map(len, tests.tokens)))
    at = np.flatnonzero(np.arange(len(tests.flat)) < len(tests.flat) - d + 1)
    at = at[(tests.owner[at] == tests.owner[at + d - 1]) & (tests.flat[at + d - 1] > 0)]
    low, high = (_bound(text, array, tests.flat, at, d, above) for above in (False, True))
    at, low, n = at[high > low], low[high > low], (high - low)[high > low]
    # Intervals longer than a turn are cut, then as many as fit are taken at once.
    cuts = np.maximum(1, -(-n // TOGETHER))
    which = np.repeat(np.arange(len(at)), cuts)
    begin = (np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * TOGETHER
    at, low, n = at[which], low[which] + begin, np.minimum(n[which] - begin, TOGETHER)
    turn = (np.cumsum(n) - 1) // TOGETHER
    padded, test_padded = np.concatenate([shard, np.zeros(1, np.int32)]), np.concatenate([tests.flat, np.zeros(1, np.int32)])
    for t in np.unique(turn):
        a, lo, m = at[turn == t], low[turn == t], n[turn == t]
        probe = np.repeat(a, m)
        place = origin[array[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]]
        # Keep what can't be extended to the left; extend the rest to the right.
        before = (place > 0) & (probe > 0) & (shard[np.maximum(place - 1, 0)] == tests.flat[np.maximum(probe - 1, 0)]) & (shard[np.maximum(place - 1, 0)] > 0)
        place, probe = place[~before], probe[~before]
        length = np.full(len(place), d, np.int64)
        alive = np.arange(len(place))
        while len(alive):
            x = padded[np.minimum(place[alive] + length[alive], len(shard))]
            y = test_padded[np.minimum(probe[alive] + length[alive], len(tests.flat))]
            alive = alive[(x == y) & (x > 0)]
            length[alive] += 1
        yield place, probe, length


def changes(item: np.ndarray, text: np.ndarray, most: int) -> int:
    """Least number of words changed, inserted or left out to find the whole ``item`` somewhere in ``text``; ``most + 1`` if more."""
    row = np.zeros(len(text) + 1, np.int64)  # the item may begin anywhere
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        # Words left over in the text: a running minimum carries the insertions along.
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1
    return int(row.min())


def _search(tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: TestSet = tests.value
        known = t.vocabulary.get
        for batch in batches:
            ids, parts, begins, n = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                numbers = np.array([known(w, 0) for w in words(text)] + [0], np.int32)
                ids.append(doc)
                begins.append(n)
                parts.append(numbers)
                n += len(numbers)
            out = {"doc_id": [], "item_id": [], "longest": [], "item_words": [], "changed": [], "word_at": []}
            if parts:
                shard, begin = np.concatenate(parts), np.array(begins)
                # For each record and item the longest match, and the diagonals on which the item may lie.
                found: dict[tuple[int, int], list] = {}
                for place, probe, length in longest_matches(shard, t):
                    docs = np.searchsorted(begin, place, "right") - 1
                    for d, o, m, p, a in zip(docs.tolist(), t.owner[probe].tolist(), length.tolist(), place.tolist(), t.at[probe].tolist()):
                        best = found.setdefault((d, o), [(0, 0), set()])
                        best[0] = max(best[0], (m, p))
                        best[1].add(p - a)
                for (d, o), ((longest, at), diagonals) in found.items():
                    item, most = t.tokens[o], t.allowed[o]
                    changed = None
                    if longest >= seed_length(len(item), t.run, t.share):
                        best = most + 1
                        first, last = begin[d], begin[d] + len(parts[d]) - 1
                        for x in sorted(diagonals):
                            lo, hi = max(first, x - most), min(last, x + len(item) + most)
                            best = min(best, changes(item, shard[lo:hi], most))
                            if best == 0:
                                break
                        changed = best if best <= most else None
                    if longest >= t.run or changed is not None:
                        for k, v in zip(out, (ids[d], t.ids[o], longest, len(item), changed, at - int(begin[d]))):
                            out[k].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def leaks(docs: DataFrame, items: DataFrame, run: int = 15, share: float = 0.1) -> DataFrame:
    """``doc_id, item_id, longest, item_words, changed, word_at`` of every record that holds test material.

    ``longest`` is the longest verbatim match in words and ``word_at`` where it
    begins in the record; ``changed`` is the number of words changed when the
    whole item is there, else null.  Case, punctuation and spacing don't count.
    Null or empty texts, in either table, leak nothing.  Whole texts are
    searched, and every record stays in one shard.

    The test set is sent to every task; its size is checked against
    ``MAX_TEST_CHARS``, and a larger one is searched in several passes.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("text is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    passes = max(1, -(-int(size) // MAX_TEST_CHARS))
    out = None
    for p in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        tests = spark.sparkContext.broadcast(TestSet([(r["item_id"], r["text"]) for r in part.toLocalIterator()], run, share))
        found = spread(docs.select("doc_id", "text")).mapInArrow(_search(tests), "doc_id long, item_id long, longest int, item_words int, changed int, word_at int")
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, run: int = 15, share: float = 0.1) -> DataFrame:
    """The records of ``docs`` that leak no test item."""
    return docs.join(leaks(docs, items, run, share).select("doc_id").distinct(), "doc_id", "left_anti")
