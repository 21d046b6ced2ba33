import json
import math
import random

import pytest
from pyspark.sql import functions as F

from seekline.functions.edit import osa
from seekline.operators import bm25, graph, hybrid, index, spell, suggest, vectors

CORPUS = [(1, "a", "Graph theory", "graph algorithms and graph search"), (2, "b", "Search engine", "a search engine ranks pages"), (3, "c", "", "cooking pasta at home")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, url string, title string, content string")


def test_postings(docs):
    got = {}
    for r in index.postings(docs).collect():
        got.setdefault(r["term"], {})[r["doc_id"]] = r["tf"]
    assert got == {"algorithms": {1: 1}, "cooking": {3: 1}, "engine": {2: 3}, "graph": {1: 4}, "home": {3: 1}, "pages": {2: 1}, "pasta": {3: 1}, "ranks": {2: 1}, "search": {1: 1, 2: 3}, "theory": {1: 2}}


def test_stats(spark, docs):
    r = index.corpus_stats(docs).first()
    assert r["n"] == 3 and math.isclose(r["avgdl"], 109 / 3)
    empty = index.corpus_stats(docs.limit(0)).first()
    assert (empty["n"], empty["avgdl"]) == (1, 1.0)
    nulls = spark.createDataFrame([(1, None, None, None)], docs.schema)
    assert index.doc_lengths(nulls).first()["len"] == 1 and index.postings(nulls).count() == 0


def score(spark, docs, terms):
    q = spark.createDataFrame([(7, terms)], "query_id long, terms array<string>")
    return bm25.score(q, index.postings(docs), index.doc_lengths(docs), index.corpus_stats(docs))


def test_bm25(spark, docs):
    got = {r["doc_id"]: r["score"] for r in score(spark, docs, ["Graph", "search", "search", "the", ""]).collect()}
    assert set(got) == {1, 2} and math.isclose(got[1], 2.111035, abs_tol=1e-6) and math.isclose(got[2], 0.758969, abs_tol=1e-6)


def test_hybrid(spark, docs):
    text = score(spark, docs, ["graph", "search", "the"])
    near = spark.createDataFrame([(7, 2, 0.9), (7, 3, 0.5), (7, 1, 0.6), (7, 99, 0.1)], "query_id long, doc_id long, similarity double").where("doc_id < 99")
    ranks = spark.createDataFrame([("a", 0.348793), ("b", 0.184382)], "url string, score double")
    got = [(r["doc_id"], r["bm25"], r["vector"], r["pagerank"], r["final"]) for r in hybrid.rank(text, near, docs, ranks).orderBy("rank").collect()]
    assert got == [(1, 1.0, 0.25, 1.0, 0.7), (2, 0.0, 1.0, 0.5286, 0.5057), (3, 0.0, 0.0, 0.0, 0.0)]
    lone = hybrid.rank(text.where("doc_id = 1"), near.where("doc_id = 1"), docs, ranks).first()
    assert (lone["bm25"], lone["vector"], lone["pagerank"], lone["final"]) == (0, 0, 0, 0)


@pytest.mark.parametrize("hub", [1 << 16, 1])
def test_pagerank(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "d"), ("a", "b"), ("a", None), (None, "b"), ("b", " ")], "source_url string, target_url string")
    docs = spark.createDataFrame([("e",)], "url string")
    got, rounds = graph.pagerank(links, docs)
    got = {r["url"]: r["score"] for r in got.collect()}
    assert rounds == 27 and math.isclose(sum(got.values()), 1, abs_tol=1e-9)
    for url, x in {"a": 0.348793, "b": 0.184382, "c": 0.367821, "d": 0.062860, "e": 0.036145}.items():
        assert math.isclose(got[url], x, abs_tol=1e-6)
    none, rounds = graph.pagerank(links.limit(0))
    assert rounds == 0 and none.count() == 0
    assert {r["url"] for r in graph.dangling(graph.nodes(graph.edges(links), docs), graph.edges(links)).collect()} == {"e"}


def test_bfs(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source_url string, target_url string")
    root = spark.createDataFrame([("a",)], "url string")
    assert {(r["url"], r["level"]) for r in graph.bfs(links, root).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.bfs(links, root, limit=2).count() == 2


DICTIONARY = [("algorithm", 100), ("algorithms", 80), ("search", 60), ("graph", 40), ("grape", 5), ("serch", 3), ("abbot", 2)]


def test_spelling(spark):
    words = spark.createDataFrame(DICTIONARY, "term string, freq long")
    asked = [(1, "Algoritm serch!"), (2, "Grape  graph"), (3, "about THE Graph"), (4, "with teh zzzzzzzz"), (5, "search2 SEARCH"), (6, None), (7, "")]
    got = {r["query_id"]: r for r in spell.correct(spark.createDataFrame(asked, "query_id long, query_text string"), words).collect()}
    assert [got[i]["corrected"] for i in range(1, 6)] == ["algorithm search!", "Grape  graph", "abbot THE Graph", "with teh zzzzzzzz", "search2 SEARCH"]
    assert got[1]["was_changed"] and not got[2]["was_changed"] and got[6]["corrected"] is None and got[7]["corrected"] == ""
    safe = spell.correct(spark.createDataFrame(asked[2:3], "query_id long, query_text string"), words, protect_index_stopwords=True).first()
    assert safe["corrected"] == "about THE Graph"



@pytest.mark.parametrize("most", [0, 16_000_000])
def test_spelling_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(spell, "FORM_BYTES", most, raising=False)
    r = random.Random(5)
    made = lambda n, letters: sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n)})
    words, terms = made(150, "abc") + made(150, "aoité"), {t: r.choice([1, 2, 5, 30, 900]) for t in made(60, "abc") + made(60, "aoité")}
    want = set()
    for w in set(words):
        near = [(d, -f, len(t), t.encode(), t) for t, f in terms.items() if t != w and (d := osa(w, t)) <= 2]
        if near and -min(near)[1] >= 10 * terms.get(w, 0):
            want.add((w, min(near)[4], min(near)[0], -min(near)[1]))
    got = spell.best_corrections(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(terms.items()), "term string, freq long"))
    assert {d for *_, d, _ in want} == {1, 2} and sorted(map(tuple, got.collect())) == sorted(want)


def executions(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    return store, [runs.apply(k).executionId() for k in range(runs.size())]


def broadcast_rows(spark, known):
    """Rows of the largest broadcast of all executions but the known ones."""
    store, now = executions(spark)
    most = 0
    for run in set(now) - set(known):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if node.name().startswith("BroadcastExchange") else []
            most = max([most, *(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))])
    return most


def test_spelling_broadcasts_no_forms(spark, tmp_path):
    r = random.Random(7)
    made = lambda n: sorted({"".join(r.choice("abcdefghij") for _ in range(10)) for _ in range(n)})
    spark.createDataFrame([(t, 1) for t in made(2000)], "term string, freq long").write.parquet(f"{tmp_path}/terms")
    asked = spark.createDataFrame(list(enumerate(made(8000))), "query_id long, query_text string")
    known = executions(spark)[1]
    assert len(spell.correct(asked, spark.read.parquet(f"{tmp_path}/terms")).collect()) == asked.count()
    assert 0 < broadcast_rows(spark, known) < 10_000

def test_merge(spark):
    old = spark.createDataFrame([("search", 1, 1), ("search", 2, 3), ("gone", 2, 1)], "term string, doc_id long, tf long")
    new = spark.createDataFrame([("search", 2, 5)], old.schema)
    once = index.merge(old, new)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(once) == [("gone", 2, 1), ("search", 1, 1), ("search", 2, 5)] == key(index.merge(once, new))
    assert key(index.merge(old, new, replace_docs=True)) == [("search", 1, 1), ("search", 2, 5)]
    a = spark.createDataFrame([("t", '{"1": 1, "2": 3}')], "term string, postings string")
    b = spark.createDataFrame([("t", '{"2":5,"10":1}'), ("u", '{"3":1}')], "term string, postings string")
    got = {r["term"]: json.loads(r["postings"]) for r in index.merge_json(a, b).collect()}
    assert got == {"t": {"1": 1, "2": 5, "10": 1}, "u": {"3": 1}}


def test_stored_postings(spark):
    rows = [(" A ", '{"1": 2}'), ("a", '{"1": 3, "2": 1}'), ("a", '{"3": 1'), (None, '{"1": 1}'), ("", '{"1": 1}'), ("b", None), ("b", "{}"), ("c", '{"x": 1}')]
    got = index.from_json(spark.createDataFrame(rows, "term string, postings string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 3), ("a", 2, 1)]


def test_versioned_table(spark, tmp_path):
    t = index.VersionedTable(spark, f"file://{tmp_path}/t", keep=1)
    rows = spark.createDataFrame([("a", 1, 1)], "term string, doc_id long, tf long")
    assert t.read(rows.schema).count() == 0
    assert t.write(rows) == 1 and t.write(t.read().unionByName(rows)) == 2 and t.read().count() == 2
    assert not (tmp_path / "t" / "v1").exists()
    # A version whose write was cut off doesn't count, and the next write takes its place.
    (tmp_path / "t" / "v3").mkdir()
    (tmp_path / "t" / "v3" / "part-0").write_text("half")
    assert t.version() == 2 and t.read().count() == 2 and t.write(t.read().limit(1)) == 3 and t.read().count() == 1


def test_titles(spark):
    rows = [("Graph",), ("graph",), ("Graph theory",), ("Grape",), ("Zoo",), (None,), ("",)]
    t = suggest.titles(spark.createDataFrame(rows, "title string"))
    assert [r["title"] for r in suggest.suggest(t, " Gra ").collect()] == ["Grape", "graph", "Graph theory"]
    assert suggest.suggest(t, "x").count() == 0 and suggest.suggest(t, "  ").count() == 0
    many = suggest.suggest_many(t, spark.createDataFrame([("gra",), ("z",), (None,), ("",)], "prefix string"))
    assert sorted((r["prefix"], r["rank"], r["title"]) for r in many.collect()) == [("gra", 1, "Grape"), ("gra", 2, "graph"), ("gra", 3, "Graph theory"), ("z", 1, "Zoo")]


def test_knn(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r["doc_id"], r["rank"]) for r in vectors.knn(q, v, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [r["doc_id"] for r in vectors.knn_one(v, [1.0, 0.0], 3).collect()] == [1, 2, 3]
    assert vectors.knn(q.limit(0), v, 2).count() == 0 and vectors.knn(q, v.limit(0), 2).count() == 0


def test_embedding(spark, docs):
    import functools

    got = vectors.embed(docs, functools.partial(vectors.hash_embedder, 16)).collect()
    assert len(got) == 3 and all(math.isclose(sum(x * x for x in r["vector"]), 1, abs_tol=1e-5) for r in got)
    assert vectors.pending(docs, spark.createDataFrame([(1,)], "doc_id long")).select(F.count("*")).first()[0] == 2


def test_knn_of_mixed_dimensions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [1.0, 0.1]), (9, [0.1, 1.0])], "query_id long, vector array<float>").coalesce(1)
    assert {(r["query_id"], r["doc_id"]) for r in vectors.knn(q, v, 1).collect()} == {(8, 1), (9, 2)}


def test_knn_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 5)).astype(float)  # many equal similarities
    x[x.any(axis=1) == False] = 1  # noqa: E712
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, vector array<float>")
    q = v.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 12)
    want = {(i, int(j), k + 1) for i in range(0, 300, 7) for k, j in enumerate(np.lexsort((np.arange(300), -sims[i]))[:6])}
    for size in (vectors.SENT_BYTES, 100):
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in vectors.knn(q, v, 6, sent_bytes=size).collect()} == want


def test_stored_vectors(spark, tmp_path):
    import numpy as np

    from seekline.operators import ann

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)]
    v = spark.createDataFrame([*x, (900, None), (901, [0.0] * 16), (902, [1.0])], "doc_id long, vector array<float>")
    stored = ann.StoredIndex(v, f"file://{tmp_path}/ann", 16)
    assert stored.table.count() == 600
    exact = {r["doc_id"] for r in vectors.knn_one(v.where("size(vector) = 16"), x[0][1], 10).collect()}
    assert len(exact & {r["doc_id"] for r in stored.search_one(x[0][1], 10).collect()}) >= 9
    asked = v.where("doc_id < 50").select(F.col("doc_id").alias("query_id"), "vector")
    want = {(r["query_id"], r["doc_id"]) for r in vectors.knn(asked, v, 10).collect()}
    got = {(r["query_id"], r["doc_id"]) for r in stored.search(asked, 10).collect()}
    assert len(got & want) / len(want) >= 0.9
    assert ann.StoredIndex(v.limit(0), f"file://{tmp_path}/none", 16).search_one([1.0] * 16, 3).count() == 0
