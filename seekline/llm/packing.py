"""Filling containers of fixed capacity with texts (problem 8).

Best-fit decreasing: the longest text first, each into the open container with
the least remaining room that still takes it, found by a segment tree over the
remaining capacities in logarithmic time.  Texts are dealt by a hash of their
identifier to blocks of bounded size, and each block is packed on its own, so
the work is spread and only the last containers of a block are less full.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.plans.lineage import materialize
from seekline.sources.tables import spread

#: Texts of one block: what one task packs at a time.
BLOCK = 50_000
#: How the vocabulary's byte pairs are split off a text. Fixed value of the public tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = os.environ.get("SEEKLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


class SegmentTree:
    """How many open containers there are for each remaining capacity; finds the least one that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = self.leaves + room
        while i:
            self.open[i] += n
            i >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least ``size`` among open containers, or -1."""
        i, tree = self.leaves + size, self.open
        if tree[i]:
            return size
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, numbered from 0; every size lies in 1..capacity. On equal sizes the earlier item goes first."""
    tree, out = SegmentTree(capacity), np.zeros(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = tree.tightest(size)
        if room < 0:
            room, bin_ = capacity, n
            n += 1
        else:
            bin_ = by_room[room].pop()
            tree.add(room, -1)
        out[i] = bin_
        if room > size:
            by_room.setdefault(room - size, []).append(bin_)
            tree.add(room - size, 1)
    return out


@functools.cache
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: No piece of text handed to the tokenizer at once is longer, so a very long text needs no more memory; texts are cut only at line ends or blanks.
_PART = re.compile(r"(?s).{1,50000}(?=\s)|.{1,50000}")


def _sizer(vocabulary: str):
    def run(batches):
        enc = _encoding(vocabulary)
        for batch in batches:
            sizes = []
            for text in batch.column(1).to_pylist():
                if text is None:
                    sizes.append(0)
                elif len(text) <= 50_000:
                    sizes.append(len(enc.encode_ordinary(text)))
                else:
                    sizes.append(sum(len(enc.encode_ordinary(p)) for p in _PART.findall(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["doc_id", "tokens"])

    return run


def token_sizes(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """``doc_id, tokens``: length of each text in tokens of the public tokenizer at ``vocabulary``; null and empty texts have 0."""
    return spread(docs.select("doc_id", F.col(text).alias("text"))).mapInArrow(_sizer(vocabulary), "doc_id long, tokens int")


def _pack(key, table):
    block, budget, capacity = (k.as_py() for k in key)
    doc, tokens = table.column("doc_id").to_numpy(), table.column("tokens").to_numpy().astype(np.int64)
    order = np.lexsort((doc, -tokens))
    doc, tokens = doc[order], tokens[order]
    # A text longer than a container becomes full containers and a rest.
    pieces = -(-tokens // capacity)
    who = np.repeat(np.arange(len(doc)), pieces)
    number = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    size = np.minimum(capacity, tokens[who] - start)
    bins = best_fit_decreasing(size, capacity)
    n = len(who)
    return pa.table({"budget_id": pa.array([budget] * n, pa.int64()), "capacity": pa.array([capacity] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "container": pa.array(bins), "doc_id": pa.array(doc[who]), "piece": pa.array(number.astype(np.int32)), "start": pa.array(start.astype(np.int32)), "tokens": pa.array(size.astype(np.int32))})


def pack(sizes: DataFrame, budgets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``budget_id, capacity, block, container, doc_id, piece, start, tokens``: where every piece of every text goes.

    ``sizes`` has (doc_id, tokens), ``budgets`` (budget_id, capacity).  A
    container is named by (budget_id, block, container).  Only a text longer
    than the capacity is split, into full containers and a rest.  Texts of 0
    tokens, and budgets with a null capacity or one below 1, are in no
    container.  Equal rows are packed once each.
    """
    sizes = materialize(sizes.select("doc_id", "tokens"), "sizes")
    n = sizes.count()
    blocks = max(1, -(-n // block))
    dealt = sizes.where("tokens > 0 and doc_id is not null").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    capacities = budgets.select("budget_id", "capacity").where("capacity >= 1 and budget_id is not null").distinct()
    # Every text is packed once for each capacity: the budgets are a stated set, a handful of rows.
    each = dealt.crossJoin(F.broadcast(capacities))
    kinds = "budget_id long, capacity int, block int, container long, doc_id long, piece int, start int, tokens int"
    return each.groupBy("block", "budget_id", "capacity").applyInArrow(_pack, kinds)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per budget: containers, items, tokens and the share of room that is used."""
    bins = packed.groupBy("budget_id", "capacity", "block", "container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    return bins.groupBy("budget_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * F.col("capacity"))).alias("fill"))


def packing_check(sizes: DataFrame, packed: DataFrame) -> DataFrame:
    """Per budget: ``texts`` with tokens, how many are ``lost`` (in no container, or with other than their tokens), ``repeated`` pieces, texts ``split`` though they fit, and ``overfull`` containers; all but the first are 0 for a right packing."""
    texts = sizes.where("tokens > 0 and doc_id is not null").groupBy("doc_id").agg(F.sum("tokens").alias("due"), F.max("tokens").alias("longest"), F.count(F.lit(1)).alias("rows"))
    budgets = packed.select("budget_id", "capacity").distinct()
    each = packed.groupBy("budget_id", "doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"))
    per = texts.crossJoin(F.broadcast(budgets)).join(each, ["budget_id", "doc_id"], "left")  # a stated set, a handful of rows
    wrong = per.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.coalesce("got", F.lit(0)) != F.col("due")).alias("lost"),
        F.count_if((F.col("rows") == 1) & (F.col("pieces") > F.col("places"))).alias("repeated"),
        F.count_if((F.col("longest") <= F.col("capacity")) & (F.col("pieces") > F.col("rows"))).alias("split"),
    )
    full = packed.groupBy("budget_id", "capacity", "block", "container").agg(F.sum("tokens").alias("used")).groupBy("budget_id").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"))
    return wrong.join(full, "budget_id")
