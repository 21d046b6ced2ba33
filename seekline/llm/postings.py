"""Reading the stored inverted index: terms with JSON postings, parsed once over Arrow buffers and cleaned.

Postings stay lists beside their term until something needs single ones, so a
shuffle moves one row for each stored row.  A term that holds more than its
share of all postings is *hot*: its lists are dealt to salts by document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.plans.lineage import materialize
from seekline.sources.tables import partitions, spread

#: A whole object of plain numbers, which is read without a JSON parser.
_PLAIN = r'^\s*\{\s*(?:"\d{1,18}"\s*:\s*\d{1,18}\s*(?:,\s*"\d{1,18}"\s*:\s*\d{1,18}\s*)*)?\}\s*$'
_WHOLE = re.compile(r"\s*[+-]?\d+\s*")
#: Pieces that a hot term's postings are dealt to.
SALTS = 16


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int64()))


_WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64))


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of lists of these sizes its list and its place there."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of numbers, none of them empty, as byte strings, each as wide as its largest number needs."""
    first = np.cumsum(sizes) - sizes
    top = np.maximum(np.maximum.reduceat(values, first), -1 - np.minimum.reduceat(values, first)) if len(sizes) else np.zeros(0, np.int64)
    width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    offsets = np.concatenate([[0], np.cumsum(sizes * width)])
    out = np.zeros(offsets[-1], np.uint8)
    row, k = _within(sizes)
    for w, kind in _WIDTHS:
        on = width[row] == w
        if on.any():
            out[(offsets[row[on]] + k[on] * w)[:, None] + np.arange(w)] = np.ascontiguousarray(values[on].astype(kind)).view(np.uint8).reshape(-1, w)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def _unpacked(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The numbers of packed lists, one list after the other."""
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    width = np.diff(offsets) // np.maximum(sizes, 1)
    row, k = _within(sizes)
    out = np.zeros(len(row), np.int64)
    for w, kind in _WIDTHS:
        on = width[row] == w
        if on.any():
            out[on] = np.ascontiguousarray(data[(offsets[row[on]] + k[on] * w)[:, None] + np.arange(w)]).view(kind).ravel()
    return out


def _packed_docs(docs: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of documents as differences from the one before, which are small."""
    steps = np.diff(docs, prepend=0)
    first = np.cumsum(sizes) - sizes
    steps[first] = docs[first]
    return _packed(steps, sizes)


def _unpacked_docs(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    steps, first = _unpacked(column, sizes), np.cumsum(sizes) - sizes
    total = np.cumsum(steps)
    return total - np.repeat(total[first] - steps[first], sizes)


def _sizes(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All runs of digits of the texts as numbers, and how many each text has."""
    column = pa.concat_arrays([column.cast(pa.large_string())])  # its buffers begin with its first text
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    digit = np.zeros(len(data) + 2, np.int8)
    digit[1:-1] = (data >= 48) & (data <= 57)
    step = np.diff(digit)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = end - start
    out = np.zeros(len(start), np.int64)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[on] = out[on] * 10 + (data[start[on] + k] - 48)
    return out, np.diff(np.searchsorted(start, offsets))


def _by_json(text: str) -> list[tuple[int, int]] | None:
    """Entries of an object that isn't plain; those without a whole number as document or count are left out; None for no object."""
    try:
        got = json.loads(text, object_pairs_hook=lambda pairs: ("object", pairs))
    except (ValueError, RecursionError):
        return None
    if not (isinstance(got, tuple) and got[0] == "object"):
        return None
    fits = lambda x: -(2**63) <= x < 2**63
    return [(int(k), v) for k, v in got[1] if _WHOLE.fullmatch(k) and fits(int(k)) and isinstance(v, int) and not isinstance(v, bool) and fits(v)]


def _rows(terms: pa.Array, docs: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    some = sizes > 0
    return pa.RecordBatch.from_arrays([terms.filter(pa.array(some)), pa.array(sizes[some], pa.int32()), _packed_docs(docs, sizes[some]), _packed(tfs, sizes[some])], names=["term", "n", "docs", "tfs"])


ROWS = "term string, n int, docs binary, tfs binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, raw = batch.column(0), batch.column(1)
        plain = pc.match_substring_regex(raw, _PLAIN)
        values, sizes = _numbers(raw.filter(plain))
        yield _rows(terms.filter(plain), values[0::2], values[1::2], sizes // 2)
        rest = pc.and_(pc.invert(plain), pc.match_substring_regex(raw, r"^\s*\{[\s\S]*\}\s*$"))
        read = [(t, e) for t, e in zip(terms.filter(rest).to_pylist(), map(_by_json, raw.filter(rest).to_pylist())) if e]
        if read:
            docs, tfs = (np.array([x[i] for _, e in read for x in e], np.int64) for i in (0, 1))
            yield _rows(pa.array([t for t, _ in read], pa.string()), docs, tfs, np.array([len(e) for _, e in read]))


def term_rows(index: DataFrame) -> DataFrame:
    """Rows ``term, n, docs, tfs`` with the term trimmed and in lower case and its ``n`` documents and counts as packed lists, written once.

    Rows with a null or blank term, null postings, or postings that are no
    complete JSON object (cut off, empty text) are skipped; whatever they lack
    stands in another row.  Entries without a whole number as document or count
    are skipped, and so are rows without an entry.
    """
    rows = spread(index.select("term", "postings")).select(F.trim(F.lower("term")).alias("term"), "postings").where("term <> '' and postings is not null")
    return materialize(rows.mapInArrow(_parse, ROWS), "rows")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"doc": pa.array(np.unique(_unpacked_docs(batch.column(1), _sizes(batch.column(0)))), pa.int64())})


def documents(rows: DataFrame) -> DataFrame:
    """One row ``docs``: the number of documents in the lists of ``term_rows``."""
    return rows.select("n", "docs").mapInArrow(_documents, "doc long").agg(F.count_distinct("doc").alias("docs"))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``term_rows`` as up to SALTS rows (term, salt, n, docs, tfs), by document."""
    for batch in batches:
        sizes = _sizes(batch.column(1))
        docs, tfs = _unpacked_docs(batch.column(2), sizes), _unpacked(batch.column(3), sizes)
        piece = np.repeat(np.arange(batch.num_rows), sizes) * SALTS + docs % SALTS
        order = np.argsort(piece, kind="stable")
        which, n = np.unique(piece, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which // SALTS)), pa.array(which % SALTS, pa.int32()), pa.array(n, pa.int32()), _packed_docs(docs[order], n), _packed(tfs[order], n)], names=["term", "salt", "n", "docs", "tfs"])


def hot_limit(spark, total: int) -> int:
    """Postings of a hot key: an eighth of a task's share, so at most 8 keys a task are hot whatever the data."""
    return max(1, total // (8 * partitions(spark)))


def salted(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` of ``term_rows`` with a ``salt``: 0, or by document where the term is in ``hot`` (a table of bounded size)."""
    cold = rows if hot is None else rows.join(F.broadcast(hot.select("term")), "term", "left_anti")
    out = cold.select("term", F.lit(0).alias("salt"), "n", "docs", "tfs")
    if hot is None:
        return out
    split = rows.join(F.broadcast(hot.select("term")), "term").select("term", "n", "docs", "tfs").mapInArrow(_dealt, "term string, salt int, n int, docs binary, tfs binary")
    return out.unionByName(split)


def united(batch_rows: Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, sizes, docs and tfs of rows sorted by key, one row a key: a document once, with its largest count.

    ``batch_rows`` gives (keys, sizes, docs, tfs); what may go on in the next
    batch, the last key's postings, is carried over.
    """
    kept: tuple[list, np.ndarray, np.ndarray] | None = None

    def unite(keys, sizes, docs, tfs):
        new = np.array([True, *(a != b for a, b in zip(keys[1:], keys))])
        at = np.repeat(np.cumsum(new) - 1, sizes)
        order = np.lexsort((-tfs, docs, at))
        at, docs, tfs = at[order], docs[order], tfs[order]
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1]) | (docs[1:] != docs[:-1])
        at, docs, tfs = at[first], docs[first], tfs[first]
        return [k for k, n in zip(keys, new) if n], np.bincount(at, minlength=int(new.sum())), docs, tfs

    for keys, sizes, docs, tfs in batch_rows:
        if not keys:
            continue
        if kept is not None:
            keys, sizes, docs, tfs = [*kept[0], *keys], np.r_[len(kept[1]), sizes], np.r_[kept[1], docs], np.r_[kept[2], tfs]
        keys, sizes, docs, tfs = unite(keys, sizes, docs, tfs)
        cut = len(docs) - int(sizes[-1])
        kept = (keys[-1:], docs[cut:], tfs[cut:])
        if len(keys) > 1:
            yield keys[:-1], sizes[:-1], docs[:cut], tfs[:cut]
    if kept is not None:
        yield kept[0], np.array([len(kept[1])]), kept[1], kept[2]


def _read(batches: Iterator[pa.RecordBatch]):
    """Batches (term, salt, n, docs, tfs) as ``united`` takes them."""
    for b in batches:
        sizes = _sizes(b.column(2))
        yield [*zip(b.column(0).to_pylist(), b.column(1).to_pylist())], sizes, _unpacked_docs(b.column(3), sizes), _unpacked(b.column(4), sizes)


def _clean(lists: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, docs, tfs in united(_read(batches)):
            total = np.add.reduceat(tfs, np.cumsum(sizes) - sizes)
            columns = {"term": pa.array([t for t, _ in keys], pa.string()), "df": pa.array(sizes, pa.int64()), "total": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"docs": _lists(docs, sizes), "tfs": _lists(tfs, sizes)} if lists else {}))

    return run


def clean_rows(rows: DataFrame, lists: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``term, df, total`` and, if asked for, ``docs, tfs`` of every term's united postings, a document once with its largest count; and the hot terms.

    One row a term; a hot term has a row for each salt, with that salt's counts.
    """
    spark = rows.sparkSession
    sizes = materialize(rows.groupBy("term").agg(F.sum("n").alias("n")), "sizes")
    every = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.where(F.col("n") >= hot_limit(spark, every)).select("term")
    hot = None if hot.isEmpty() else hot
    laid = salted(rows, hot).repartition(partitions(spark), "term", "salt").sortWithinPartitions("term", "salt")
    return materialize(laid.mapInArrow(_clean(lists), "term string, df long, total long" + ", docs array<long>, tfs array<long>" * lists), "postings"), hot


def clean_postings(index: DataFrame) -> DataFrame:
    """``term, docs, tfs, df, total``: the united postings, several rows for a hot term; ``df`` and ``total`` are the whole term's in any case."""
    clean, hot = clean_rows(term_rows(index))
    if hot is None:
        return clean
    whole = clean.join(F.broadcast(hot.select("term")), "term").groupBy("term").agg(F.sum("df").alias("all_df"), F.sum("total").alias("all_total"))
    return clean.join(F.broadcast(whole), "term", "left").select("term", "docs", "tfs", F.coalesce("all_df", "df").alias("df"), F.coalesce("all_total", "total").alias("total"))
