import datetime as dt

from pyspark.sql import functions as F

from seekline.operators.orphans import Relation, normal_url, orphan_cascade, orphan_report
from seekline.plans import orphan_queries

T = dt.datetime


def test_normal_url(spark):
    rows = [("HTTPS://H.Org/A#x", "https://h.org/A"), ("http://h?Q#", "http://h?Q"), ("mailto:x", None), (None, None), ("", None), ("#https://h", None), ("https://h/a#b#c", "https://h/a")]
    got = spark.createDataFrame(rows, "u string, want string").select("want", normal_url(F.col("u")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def tables(spark):
    docs = spark.createDataFrame([("http://a", T(2024, 1, 1), "x"), ("http://a", T(2024, 3, 1), "x"), ("http://b", T(2024, 2, 15), "x"), (None, None, "x")], "url string, created_at timestamp, target_url string")
    links = spark.createDataFrame(
        [("http://a", "http://b", T(2024, 2, 1)), ("http://a", "http://b", T(2024, 2, 20)), ("HTTP://A#f", "http://gone", None), ("http://a", "http://none", T(2024, 1, 5)), ("http://a", None, None), (None, " ", T(2024, 1, 1))],
        "source_url string, target_url string, found_at timestamp",
    )
    gone = spark.createDataFrame([("http://gone",), ("http://gone",), (None,)], "url string")
    return docs, links, gone


def test_states(spark):
    docs, links, gone = tables(spark)
    rel = [Relation("links", "source_url", links, "documents", "found_at"), Relation("links", "target_url", links, "documents", "found_at")]
    got = orphan_cascade(rel, {"documents": (docs, "url", "created_at")}, (gone, "url"))
    rows = sorted((r["ref_field"], r["url"], r["period"], r["state"], r["rows"]) for r in got.collect())
    assert rows == [("target_url", "http://b", "2024-02", "late", 2), ("target_url", "http://gone", "unknown", "deleted", 1), ("target_url", "http://none", "2024-01", "missing", 1)]
    assert orphan_report(got).count() == 3
    none = orphan_cascade([Relation("links", "target_url", links.limit(0), "documents")], {"documents": (docs, "url", None)})
    assert none.count() == 0
    all_missing = orphan_cascade([Relation("links", "source_url", links, "documents", "found_at")], {"documents": (docs.limit(0), "url", "created_at")})
    assert {r["state"] for r in all_missing.collect()} == {"missing"}


def test_cascade_and_cycle(spark):
    docs = spark.createDataFrame([("http://a",)], "url string")
    mid = spark.createDataFrame([("http://m1", "http://a"), ("http://m2", "http://none"), ("http://m3", "http://m2"), ("http://m3", "http://a")], "id string, up string")
    leaf = spark.createDataFrame([("http://m1",), ("http://m2",), ("http://m3",), ("http://zz",)], "ref string")
    rel = [Relation("mid", "up", mid.where("up <> 'http://m2'"), "docs", key="id"), Relation("leaf", "ref", leaf, "mid")]
    got = {(r["url"], r["kind"], r["depth"]) for r in orphan_cascade(rel, {"docs": (docs, "url", None)}).where("ref_table = 'leaf'").collect()}
    assert got == {("http://zz", "direct", 0), ("http://m2", "inherited", 1)}
    ring = spark.createDataFrame([("http://x", "http://y"), ("http://y", "http://x"), ("http://z", "http://q"), ("http://w", "http://z"), ("http://v", "http://w")], "id string, up string")
    got = {(r["url"], r["kind"], r["depth"]) for r in orphan_cascade([Relation("ring", "up", ring, "ring", key="id")], {}).collect()}
    assert got == {("http://q", "direct", 0), ("http://z", "inherited", 1), ("http://w", "inherited", 2)}


def test_p5_found_comes_by_rounds(spark, tmp_path, monkeypatch):
    """Links to pages with a score row are orphans by that row, others by documents; the state is that of the page."""
    when = T(2024, 1, 5)
    stored = {
        "documents": ([("http://late", T(2024, 3, 1)), ("http://kept", T(2023, 1, 1)), ("http://unscored", T(2023, 1, 1))], "url string, created_at timestamp"),
        "links": ([("http://kept", u, when) for u in ("HTTP://Gone#x", "http://lost", "http://late", "http://unscored", "http://gone2", "http://lost2", "mailto:x")] + [("http://lost", "http://gone", None)], "source_url string, target_url string, found_at timestamp"),
        "pagerank": ([("http://gone", when), ("http://LOST", None), ("http://late", when), ("http://kept", when), (None, when)], "url string, updated_at timestamp"),
        "deleted_pages": ([("http://gone",), ("http://gone2",), ("http://late",)], "url string"),
    }
    for name, (rows, schema) in stored.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    cascades = []
    monkeypatch.setattr(orphan_queries, "orphan_cascade", lambda *a: cascades.append(orphan_cascade(*a)) or cascades[-1])
    got = sorted(tuple(r) for r in orphan_queries.p5_found(spark, str(tmp_path)).collect())
    assert got == [
        ("links", "source_url", "http://lost", "unknown", "missing"),
        ("links", "target_url", "http://gone", "2024-01", "deleted"),
        ("links", "target_url", "http://gone", "unknown", "deleted"),
        ("links", "target_url", "http://gone2", "2024-01", "deleted"),
        ("links", "target_url", "http://late", "2024-01", "late"),
        ("links", "target_url", "http://lost", "2024-01", "missing"),
        ("links", "target_url", "http://lost2", "2024-01", "missing"),
        ("pagerank", "url", "http://gone", "2024-01", "deleted"),
        ("pagerank", "url", "http://late", "2024-01", "late"),
        ("pagerank", "url", "http://lost", "unknown", "missing"),
    ]
    steps = {(r["ref_table"], r["url"], r["kind"], r["depth"]) for r in cascades[0].collect()}
    assert {s for s in steps if s[3]} == {("links", "http://gone", "inherited", 1), ("links", "http://lost", "inherited", 1)}
    assert {s[1] for s in steps if s[0] == "links" and not s[3]} == {"http://gone2", "http://lost2", "http://late"}
