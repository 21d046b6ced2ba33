import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekline.llm import dfr, heavy, leakage, neardup, neighbours, postings, termfreq
from seekline.llm.words import words

S = neighbours.Settings(dim=8, k=3, per_list=40, probes=3, pieces=4, codes=16, rerank=24, block=50, query_block=90)


def exact(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -9)
    return {int(ids[r]): [int(ids[c]) for c in np.lexsort((ids, -sims[r]))[:k]] for r in range(len(ids))}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "doc_id long, vector array<float>").withColumn("id", F.lit("clash")).withColumn("rep", F.lit(1))
    got: dict = {}
    for r in neighbours.nearest_neighbours(df, S).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append(r["neighbour"])
    want = exact(rows, 3)
    assert set(got) == set(want)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values())) >= 0.9
    assert all(i not in n for i, n in got.items())


def test_long_lists_are_split(spark):
    import dataclasses

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    few = dataclasses.replace(S, max_lists=2, per_list=50, block=300, query_block=4000)
    got: dict = {}
    for r in neighbours.nearest_neighbours(df, few).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append(r["neighbour"])
    want = exact(rows, 3)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values())) >= 0.9
    assert neighbours.recall(df, few).first()["recall"] >= 0.9


def test_neighbours_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] + [0.0] * 7) for i in range(40)] + [(100 + i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)] + [(5, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame([r for r in rows[:-1]], "doc_id long, vector array<float>")
    got = {(r["doc_id"], r["rank"]): r["neighbour"] for r in neighbours.nearest_neighbours(df, S).where("doc_id < 100").collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [1, 2, 3] and [got[30, k] for k in (1, 2, 3)] == [0, 1, 2]
    assert neighbours.neighbour_pairs(df.limit(0), S).count() == 0
    assert neighbours.neighbour_pairs(df.where("doc_id = 100"), S).count() == 0


def jaccard_pairs(rows, n, t):
    sets = {}
    for i, title, content in rows:
        if content is not None:
            w = words(f"{title or ''} {content}")
            if len(w) >= n:
                sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = rows[rng.integers(0, len(rows))][2].split(" ")
            for _ in range(rng.integers(0, 4)):
                base[rng.integers(0, len(base))] = vocabulary[rng.integers(0, 60)]
            text = " ".join(base)
        else:
            text = " ".join(vocabulary[k] for k in rng.integers(0, 60, rng.integers(8, 50)))
        rows.append((i, None if i % 5 else "Title", text))
    return rows


@pytest.mark.parametrize("node", [256, 4])
def test_near_duplicates(spark, monkeypatch, node):
    monkeypatch.setattr(neardup, "NODE", node)
    rows = corpus(np.random.default_rng(node), 120) + [(900, "x", None), (901, None, ""), (902, None, "two words"), (903, "", "Same, text here!"), (904, "same", "TEXT here")]
    df = spark.createDataFrame(rows, "doc_id long, title string, content string").withColumn("size", F.lit(1)).withColumn("node", F.lit(2))
    # Nodes of four records force the descent; functions are sent by value with the changed bound.
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(neardup)
    try:
        got = {tuple(r) for r in neardup.duplicate_pairs(df, 3, 0.7).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(neardup)
    assert got == jaccard_pairs(rows, 3, 0.7)
    assert (903, 904) in got


def test_large_class_and_groups(spark):
    rows = [(i, "t", "the very same text of several words in all") for i in range(neardup.EXPAND + 6)] + [(500, "t", "the very same text of several words in all indeed")]
    df = spark.createDataFrame(rows, "doc_id long, title string, content string")
    got = {tuple(r) for r in neardup.duplicate_pairs(df, 3, 0.7).collect()}
    assert got == {(0, i) for i in range(1, neardup.EXPAND + 6)} | {(0, 500)}
    # Of a large class, texts that differ though their sets don't are all linked, with each other and outside.
    mixed = [(1000 + i, "t", t) for i, t in enumerate(["THE very same text of several words in all"] * 3 + ["the very same text, of several words in all!"] * 2)]
    both = {tuple(r) for r in neardup.duplicate_pairs(spark.createDataFrame(rows + mixed, df.schema), 3, 0.7).collect()}
    assert both - got == {(0, 1000), (0, 1003), (1000, 1003), (1000, 1001), (1000, 1002), (1003, 1004), (500, 1000), (500, 1003)} and got <= both
    groups = neardup.duplicate_groups(df, 3, 0.7).collect()
    assert {r["group_id"] for r in groups} == {0} and len(groups) == len(rows) and {r["links"] for r in groups} == {1}
    assert neardup.duplicate_pairs(df.limit(0), 3, 0.7).count() == 0 and neardup.duplicate_groups(df.limit(0)).count() == 0


INDEX = [(" Cat ", '{"1": 2, "2": 1}'), ("cat", '{"2": 4, "3": 1}'), ("cat", '{"4": 1'), ("DOG", '{"1":1}'), ("dog", None), (None, '{"9": 1}'), ("  ", '{"9": 1}'), ("owl", "{}"), ("ant", '{"1": 1, "5": 3, "x": 1}'), ("ant", '{"1": 1, "5": 3}')]


@pytest.fixture()
def stored(spark):
    return spark.createDataFrame(INDEX, "term string, postings string").withColumn("doc_id", F.lit("clash")).withColumn("tf", F.lit(0))


def test_frequencies(spark, stored):
    got = {r["term"]: (r["total_count"], r["doc_count"], r["mark"]) for r in termfreq.term_frequencies(stored, rare_docs=1, common_share=0.7).collect()}
    assert got == {"cat": (7, 3, "common"), "dog": (1, 1, "rare"), "ant": (4, 2, None)}
    assert termfreq.term_frequencies(stored.limit(0)).count() == 0
    ids = termfreq.build_dictionary(spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("é",)], "term string")).orderBy("term_id").collect()
    assert [(r["term"], r["term_id"]) for r in ids] == [("a", 0), ("b", 1), ("é", 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1) | st.integers(0, 300), st.integers(0, 10**18) | st.integers(1, 9)), min_size=1, max_size=6), max_size=6))
def test_packed_lists(lists):
    sizes = np.array([len(x) for x in lists], np.int64)
    docs, tfs = (np.array([e[i] for x in lists for e in x], np.int64) for i in (0, 1))
    column = postings._packed_docs(docs, sizes)
    assert postings._unpacked_docs(column, sizes).tolist() == docs.tolist() and postings._unpacked(postings._packed(tfs, sizes), sizes).tolist() == tfs.tolist()
    if len(lists) > 1:
        assert postings._unpacked_docs(column.slice(1), sizes[1:]).tolist() == docs[sizes[0] :].tolist()


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "BLOCK", 8)
    rows = [(f"t{i:03d}", '{"%d": %d, "7": 1}' % (i, i + 1)) for i in range(100)]
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(termfreq)
    try:
        got = {r["term"]: (r["total_count"], r["doc_count"]) for r in termfreq.term_frequencies(spark.createDataFrame(rows, "term string, postings string")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(termfreq)
    assert got == {f"t{i:03d}": (i + 2, 2) if i != 7 else (8, 1) for i in range(100)}


def test_characteristic_terms(stored):
    got = dfr.dfr_scores(stored).where("term = 'cat' and doc_id = 2").first()
    tfn = 4 * math.log2(1 + (4 + 4 + 1 + 3) / 4 / 4)
    rate = 7 / 4
    assert math.isclose(got["dfr"], (math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1), rel_tol=1e-9)
    top = [(r["doc_id"], r["term"], r["rank"]) for r in dfr.characteristic_terms_checked(stored, 2).orderBy("doc_id", "rank").collect()]
    assert top == [(1, "dog", 1), (1, "ant", 2), (2, "cat", 1), (3, "cat", 1), (5, "ant", 1)]
    assert dfr.characteristic_terms(stored, 1).count() == 4 and dfr.characteristic_terms_checked(stored.limit(0)).count() == 0


def test_checked_terms_lose_nothing(spark):
    rng = np.random.default_rng(1)
    docs = {d: {f"t{int(k)}": int(rng.integers(1, 6)) for k in rng.zipf(1.4, 40) % 300} for d in range(80)}
    index: dict = {}
    for d, terms in docs.items():
        for t, n in terms.items():
            index.setdefault(t, {})[d] = n
    rows = [(t, "{" + ", ".join(f'"{d}": {n}' for d, n in p.items()) + "}") for t, p in index.items()]
    got: dict = {}
    for r in dfr.characteristic_terms_checked(spark.createDataFrame(rows, "term string, postings string")).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append(r["term"])
    for d, terms in docs.items():
        best = sorted(terms, key=lambda t: (-round((1 + math.log(terms[t])) * math.log(80 / len(index[t])), 12), t))[:3]
        assert got[d] == best


def test_frequent_items(spark):
    rows = [("  Big  CAT ",)] * 60 + [("big cat",)] * 60 + [("dog",)] * 50 + [(f"q{i}",) for i in range(800)] + [(None,), ("  ",), ("",)]
    df = spark.createDataFrame(rows, "query_text string").withColumn("id", F.lit(1)).withColumn("item", F.lit("clash"))
    got = {r["item"]: (r["exact_count"], r["approx_count"] >= r["exact_count"]) for r in heavy.frequent_items(df, "query_text", 0.05, 3, 256).collect()}
    assert got == {"big cat": (120, True), "dog": (50, True)}
    assert heavy.frequent_items(df.limit(0), "query_text", 0.05).count() == 0
    with pytest.raises(ValueError):
        heavy.frequent_items(df, "query_text", 0.001, 3, 256)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_leaks(spark):
    w = ITEM.split()
    swap = w.copy()
    swap[4], swap[12] = "x", "y"
    three = swap.copy()
    three[17] = "z"
    docs = [
        (1, f"Before {ITEM.upper()}, after!"), (2, "a " + " ".join(swap) + " b"), (3, " ".join(three)), (4, " ".join(w[2:17])), (5, " ".join(w[2:16])),
        (6, None), (7, ""), (8, " ".join(w[:10]) + " extra " + " ".join(w[10:])), (9, "filler " * 30_000 + ITEM), (1, f"Before {ITEM.upper()}, after!"), (None, ITEM), (10, " ".join(w[:10] + w[11:])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(70, ITEM, None), (71, None, "s"), (72, "", "s"), (73, "one two", "s")], "item_id long, text string, suite string")
    got = sorted((r["doc_id"], r["changed"], r["longest"]) for r in leakage.leaks(df, items).where("item_id = 70").collect() if r["changed"] is not None)
    assert got == [(1, 0, 20), (1, 0, 20), (2, 2, 7), (8, 1, 10), (9, 0, 20), (10, 1, 10)]
    run = {r["doc_id"] for r in leakage.leaks(df, items).where("item_id = 70 and changed is null").collect()}
    assert run == {4}
    assert {r["doc_id"] for r in leakage.leaks(df, items).where("item_id = 73").collect()} == {1, 2, 3, 8, 9, 10}
    assert leakage.without_leaks(df, items.where("item_id = 70")).where("doc_id in (1, 2, 4)").count() == 0
    assert leakage.leaks(df.limit(0), items).count() == 0 and leakage.leaks(df, items.limit(0)).count() == 0


def test_suffix_array_and_matches(monkeypatch):
    rng = np.random.default_rng(7)
    text = rng.integers(0, 3, 300).astype(np.int32)
    got = leakage.suffix_array(text, 300)
    assert got.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
    items = [" ".join(f"w{k}" for k in rng.integers(0, 4, 24)) for _ in range(6)]
    tests = leakage.TestSet([(i, t) for i, t in enumerate(items)], 4, 0.1)
    shard = np.array([tests.vocabulary.get(f"w{k}", 0) for k in rng.integers(0, 5, 900)], np.int32)
    want = set()
    for p in range(len(shard)):
        for q in range(len(tests.flat)):
            n = 0
            while p + n < len(shard) and q + n < len(tests.flat) and shard[p + n] == tests.flat[q + n] > 0:
                n += 1
            if n >= tests.seed and not (p and q and shard[p - 1] == tests.flat[q - 1] > 0):
                want.add((p, q, n))
    for together in (1 << 20, 7):
        monkeypatch.setattr(leakage, "TOGETHER", together)
        assert {x for block in leakage.longest_matches(shard, tests) for x in zip(*(c.tolist() for c in block))} == want


def test_alignment():
    a = np.array([1, 2, 3, 4])
    assert leakage.changes(a, np.array([9, 1, 2, 3, 4, 9]), 2) == 0
    assert leakage.changes(a, np.array([1, 2, 9, 4]), 2) == 1 and leakage.changes(a, np.array([1, 2, 9, 3, 4]), 2) == 1
    assert leakage.changes(a, np.array([1, 2, 4]), 2) == 1 and leakage.changes(a, np.array([8, 8]), 2) == 3
