import datetime as dt
import time

import pytest

from pyspark.sql import functions as F

from seekline.operators import analytics, answer, html
from seekline.plans.engine import Engine, register_functions
from seekline.sources import adapters, tables
from seekline.streaming import live_index, query_log

SCHEMA = "id long, query_text string, result_count int, top_score double, latency_ms int, searched_at timestamp"


def test_buckets(spark):
    log = spark.createDataFrame([(i, "q", 1, x, 1, None) for i, x in enumerate([0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.01, -0.1, None])], SCHEMA)
    assert tuple(analytics.score_buckets(log).first()) == (1, 1, 1, 1, 2)
    assert tuple(analytics.score_buckets(log.limit(0)).first()) == (None,) * 5
    assert analytics.average_top_score(log.limit(0)).first()[0] == 0 and analytics.zero_results(log.limit(0)).first()[0] == 0
    assert sum(r["share"] for r in analytics.bucket_shares(log).collect()) == 1
    assert {r["share"] for r in analytics.bucket_shares(log.limit(0)).collect()} == {0}


def test_trending(spark):
    at = dt.datetime(2024, 1, 8)
    log = spark.createDataFrame([(1, "old", 0, 0.0, 1, at - dt.timedelta(days=7)), (2, "new", 0, 0.0, 1, at - dt.timedelta(days=6)), (3, "b", 0, 0.0, 1, at), (4, None, 0, 0.0, 1, None)], SCHEMA)
    assert [r["query_text"] for r in analytics.trending(log, "2024-01-08 00:00:00").collect()] == ["b", "new"]


def test_history(spark):
    rows = [("u", "a", 1), ("u", "b", 2), ("u", "a", 3), (None, "x", 1), ("u", None, 9)]
    got = analytics.history(spark.createDataFrame(rows, "user string, text string, at int"), "user", "text", "at")
    assert [(r["query_text"], r["rank"]) for r in got.orderBy("rank").collect()] == [("a", 1), ("b", 2)]


PAGE = '<html><head><title>Graph - Wikipedia</title><style>x{}</style></head><body><div id="bodyContent">Hello\n <b>big</b><script>"</p>"</script><div class="navbox big">no</div> world</div>out</body></html>'


def test_pages(spark):
    got = {r["url"]: r for r in html.pages(spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")).collect()}
    assert (got["u"]["title"], got["u"]["text"]) == ("Graph", "Hello big world")
    assert got["v"]["title"] is None and got["v"]["text"] is None


def test_links(spark):
    hrefs = [("/wiki/A", None), ("/wiki/A", None), ("/wiki/A#x", None), ("/wiki/File:Z", None), ("/wiki/B_(disambiguation)", None), ("#top", None), ("https://other/wiki/C", None), ("/wiki/D", "fr"), ("/wiki/E", "en")]
    page = "".join(f'<a href="{h}"' + (f' lang="{x}"' if x else "") + ">t</a>" for h, x in hrefs)
    parsed = html.pages(spark.createDataFrame([("https://h/wiki/S", page)], "url string, html string"), None)
    assert [r["target_url"] for r in html.page_links(parsed, "https://h").collect()] == ["https://h/wiki/A", "https://h/wiki/A#x", "https://h/wiki/E"]


def test_fetch_and_save(spark):
    pages = {"a": PAGE}
    got = {r["url"]: r["html"] for r in html.fetch(spark.createDataFrame([("a",), ("b",)], "url string"), pages.__getitem__).collect()}
    assert got["a"] == PAGE and got["b"] is None
    parsed = spark.createDataFrame([("a", "t", "x"), ("a", "t", "x"), ("b", "", "x"), ("c", "t", "x")], "url string, title string, text string")
    assert [r["url"] for r in html.new_documents(parsed, spark.createDataFrame([("c",)], "url string")).collect()] == ["a"]


def test_adapters():
    ask = adapters.chain(lambda p: (None, "rate_limited"), lambda p: ("text", None))
    assert ask("x") == ("text", None) and adapters.chain(lambda p: 1 / 0)("x") == (None, "error")
    both = {"local": lambda p: (None, "error"), "hosted": lambda p: ("text", None)}
    assert adapters.route(both)("x") == ("text", None) and adapters.route(both, "local")("x") == (None, "error") and adapters.route(both, "none")("x") == (None, "no_key")
    assert adapters.within(0.05, lambda: time.sleep(0.5), "late") == "late" and adapters.within(1, lambda: 5, 0) == 5
    assert adapters.synonyms_of('x ["a", 1, "b"] y') == ["a", "b"] and adapters.synonyms_of("[") == []
    now = [dt.datetime(2024, 1, 1)]
    calls = []
    geo = adapters.Geocoder(lambda q: calls.append(q) or ({"lat": 1.0} if q == "rome" else None), clock=lambda: now[0])
    assert geo.find(" Rome ")["found"] and geo.find("rome")["lat"] == 1.0 and calls == ["rome"]
    now[0] += dt.timedelta(hours=25)
    assert geo.find("rome")["found"] and len(calls) == 2 and geo.find("x") == {"found": False} and geo.find(" ") == {"found": False}
    text = "".join(adapters.sse_text([("a", {"x": 1})])) + "event: b\ndata: {bad\n\n"
    assert adapters.parse_sse(text) == [("a", {"x": 1}), ("b", None)]


def test_summaries(spark):
    q = spark.createDataFrame([(1, "informational"), (2, "navigational"), (3, "technical")], "query_id long, intent string")
    r = spark.createDataFrame([(1, 1, "T", "A <mark>b</mark>. C."), (2, 1, "T", "x")], "query_id long, rank int, title string, snippet string")
    got = {x["query_id"]: x for x in answer.summarize(q, r).collect()}
    assert got[1]["answer"] == "A b. C." and got[1]["sentences"] == ["A b.", "C."]
    assert got[2]["reason"] == "skipped_navigational" and got[3]["reason"] == "no_results"
    by_model = lambda m: {x["query_id"]: x for x in answer.summarize(q, r, model=m).collect()}
    told = by_model(lambda p: ("Yes.\nSOURCES: One. Two.", None))
    assert (told[1]["answer"], told[1]["sentences"]) == ("Yes.", ["One.", "Two."]) and told[2]["reason"] == "skipped_navigational" and told[3]["reason"] == "no_results"
    assert by_model(adapters.no_model)[1]["reason"] == "no_key" and by_model(lambda p: ("\nSOURCES: x", None))[1]["reason"] == "parse_failed"
    assert by_model(lambda p: 1 / 0)[1]["reason"] == "error"


def test_engine(spark):
    docs = spark.createDataFrame([(1, "a", "Graph theory", "graph algorithms and graph search"), (2, "b", "Search engine", "a search engine ranks pages"), (3, "c", None, "cooking pasta at home")], "doc_id long, url string, title string, content string")
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "source_url string, target_url string")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, vector array<float>")
    log = spark.createDataFrame([(1, "graph", 1, 0.5, 1, None)], SCHEMA)
    e = Engine(docs, links, emb, log)
    q = spark.createDataFrame([(1, "serch graph", [1.0, 0.0]), (2, "  ", None), (3, "pasta", None)], "query_id long, query_text string, vector array<float>")
    got = e.search(q).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got][:2] == [(1, 1), (1, 2)] and {r["query_id"] for r in got} == {1, 3}
    assert "<mark>" in got[0]["snippet"] and got[0]["corrected"] == "search graph" and got[0]["scores"]["final"] > 0
    assert e.log_entries(e.search(q), 5).where("query_text = 'serch graph'").count() == 1
    names = [n for n, _ in e.stream_search("graph")]
    assert names == ["spellcheck", "expansion", "results", "summary", "done"]
    assert [n for n, _ in e.stream_search("  ")] == ["error"]
    assert [n for n, _ in e.stream_search("graph", gone=lambda: True)] == ["spellcheck"]
    left = e.stream_search("graph")
    next(left)
    left.close()
    assert "HashAggregate" in e.plan(q)
    assert e.health()["documents"] == 3 and [r["title"] for r in e.suggest("gr").collect()] == ["Graph theory"]
    assert e.analytics()["topQueries"].first()["hits"] == 1 and e.trending("2030-01-01 00:00:00").count() == 0
    register_functions(spark)
    assert spark.sql("select tokenize('The big Cat') t, osa_distance('ab', 'ba') d, cosine_sim(array(1D), array(2D)) c").first()[:] == (["big", "cat"], 1, 1.0)


def test_live_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    first = '{"url":"a","title":"T a","text":"graph search","event_time":"2024-01-01T00:00:00"}\nbroken\n{"url":"a","title":"T a","text":"graph search","event_time":"2024-01-01T00:00:00"}\n{"url":"b","title":"","text":"x","event_time":"2024-01-01T00:00:00"}\n'
    (tmp_path / "in" / "1.json").write_text(first)
    live = live_index.LiveIndex(spark, f"file://{tmp_path}/index")

    def run():
        live.start(live_index.valid_events(live_index.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "ck")).awaitTermination(120)

    run()
    assert sorted(r["term"] for r in live.postings().collect()) == ["graph", "search"] and live.documents().count() == 1
    (tmp_path / "in" / "2.json").write_text('{"url":"c","title":"New page","text":"graph","event_time":"2024-01-01T01:00:00"}\n')
    run()
    assert live.documents().count() == 2 and live.postings().where("term = 'graph'").count() == 2
    before = sorted(map(tuple, live.postings().collect()))
    live.apply(spark.createDataFrame([("c", "New page", "graph")], "url string, title string, text string"))
    assert sorted(map(tuple, live.postings().collect())) == before
    assert live_index.corrupt_events(spark.createDataFrame([("x", None), (None, "u")], "_corrupt string, url string")).count() == 1


def read_all(live):
    return {r["url"]: r["content"] for r in live.documents().collect()}, sorted((r["term"], r["doc_id"], r["tf"]) for r in live.postings().collect())


def test_crash_between_steps_loses_nothing(spark, tmp_path, monkeypatch):
    from seekline.streaming.store import IndexStore

    live = live_index.LiveIndex(spark, f"file://{tmp_path}/index", fan=3)
    batch = lambda *rows: spark.createDataFrame(list(rows), "url string, title string, text string")
    live.apply(batch(("a", "Ta", "graph"), ("b", "Tb", "search")))
    live.apply(batch(("c", "Tc", "graph")))
    before = read_all(live)
    for step in ("_commit", "_write", "compact", "vacuum"):
        with monkeypatch.context() as m:
            m.setattr(IndexStore, step, lambda *a, **k: 1 / 0)
            try:
                live.apply(batch(("a", "Ta", "tree")))
                raise AssertionError
            except ZeroDivisionError:
                pass
        if step in ("_commit", "_write"):
            assert read_all(live) == before
    live.apply(batch(("a", "Ta", "tree")))
    docs, posts = read_all(live)
    assert docs == {"a": "tree", "b": "search", "c": "graph"} and [t for t, _, _ in posts] == ["graph", "search", "ta", "tb", "tc", "tree"]
    for i in range(10):
        live.apply(batch(("a", "Ta", f"word{i}"), (f"n{i}", "New", "graph")))
    docs, posts = read_all(live)
    assert len(docs) == 13 and docs["a"] == "word9" and sum(t.startswith("word") for t, _, _ in posts) == 1 and sum(t == "graph" for t, _, _ in posts) == 11
    # Parts are merged, and what no entry lists is gone.
    assert len(live.store.parts()) <= 6 and len(list((tmp_path / "index" / "postings").glob("part=*"))) <= 12
    assert sorted(r["term"] for r in live.postings(spark.createDataFrame([("word9",), ("none",)], "term string")).collect()) == ["word9"]


def test_geocode_table(spark):
    now, calls = dt.datetime(2024, 1, 2), spark.sparkContext.accumulator(0)
    place = "query string, found boolean, lat double, lon double, display_name string, expires_at timestamp"
    cache = spark.createDataFrame([("rome", True, 1.0, 2.0, "Roma", now + dt.timedelta(hours=1)), ("oslo", True, 9.0, 9.0, "old", now - dt.timedelta(hours=1))], place)

    def lookup(q):
        calls.add(1)
        return {"lat": 5.0, "lon": 6.0, "display_name": q.title()} if q == "oslo" else None if q == "atlantis" else 1 / 0

    asked = spark.createDataFrame([(" Rome ",), ("OSLO",), ("oslo",), ("atlantis",), ("broken",), (" ",), (None,)], "query string")
    answers, kept = adapters.geocode(asked, cache, lookup, now)
    assert {(r["query"], r["found"], r["display_name"]) for r in answers.collect()} == {("rome", True, "Roma"), ("oslo", True, "Oslo"), ("atlantis", False, None), ("broken", False, None)}
    assert {r["query"] for r in kept.collect()} == {"rome", "oslo", "atlantis"} and calls.value == 3
    assert {r["query"] for r in adapters.geocode(asked, kept, lookup, now)[0].collect()} == {"rome", "oslo", "atlantis", "broken"} and calls.value == 4


def test_pages_and_upserts(spark):
    docs = spark.createDataFrame([(i, f"u{i}") for i in range(10)] + [(None, "x")], "doc_id long, url string")
    assert [r["doc_id"] for r in tables.page(docs, "doc_id", 4).collect()] == [0, 1, 2, 3] and [r["doc_id"] for r in tables.page(docs, "doc_id", 4, 7).collect()] == [8, 9]
    assert tables.by_url(docs, "u3").count() == 1 and tables.by_url(docs, "none").count() == 0
    new = spark.createDataFrame([(3, "changed"), (77, "added")], docs.schema)
    got = {r["doc_id"]: r["url"] for r in tables.upsert(docs.where("doc_id is not null"), new, "doc_id").collect()}
    assert len(got) == 11 and got[3] == "changed" and got[77] == "added" and got[4] == "u4"


def test_layout(spark, tmp_path):
    from seekline.plans.layout import laid, lay_out

    links = spark.range(200).selectExpr("concat('s', id) as source_url", "concat('t', id % 7) as target_url")
    log = spark.createDataFrame([(1, "q", dt.datetime(2024, 1, 1)), (2, "q", dt.datetime(2024, 1, 9)), (3, "q", None)], "id long, query_text string, searched_at timestamp")
    lay_out({"links": links, "query_log": log}, str(tmp_path))
    assert laid(spark, str(tmp_path), "links_by_target").where("target_url = 't3'").count() == 29 and laid(spark, str(tmp_path), "links_by_source").count() == 200
    assert laid(spark, str(tmp_path), "query_log").where("day = '2024-01-09'").first()["id"] == 2 and laid(spark, str(tmp_path), "query_log").count() == 3


def test_publish(spark, tmp_path):
    tables.publish(spark.createDataFrame([("a", "T", "text", dt.datetime(2024, 1, 1))], "url string, title string, content string, created_at timestamp"), str(tmp_path / "events"))
    seen = live_index.read_events(spark, str(tmp_path / "events")).writeStream.format("memory").queryName("announced").trigger(availableNow=True).start()
    seen.awaitTermination(120)
    r = spark.table("announced").first()
    assert (r["url"], r["title"], r["text"], r["_corrupt"]) == ("a", "T", "text", None)
    docs = spark.createDataFrame([("a", "Stored", "as stored")], "url string, title string, content string")
    joined = live_index.with_documents(live_index.complete_events(live_index.read_events(spark, str(tmp_path / "events"))), docs)
    joined.writeStream.format("memory").queryName("joined").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("joined").first()["text"] == "as stored"


def test_jdbc(spark, tmp_path):
    jars = [str(j) for j in spark.sparkContext._jsc.sc().listJars().mkString(",").split(",") if j]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).selectExpr("id", "concat('u', id) as url")
    try:
        rows.write.jdbc(url, "docs", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    except Exception as e:  # the driver isn't part of every distribution
        pytest.skip(f"no row store here: {str(e)[:80]} {jars}")
    got = tables.jdbc_table(spark, url, "docs", "id", 0, 100, parts=4)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 100


def test_log_stream(spark, tmp_path):
    spark.createDataFrame([(1, "q", dt.datetime(2024, 1, 1))], "id long, query_text string, searched_at timestamp").write.parquet(str(tmp_path / "log"))
    source = lambda: spark.readStream.schema("id long, query_text string, searched_at timestamp").parquet(str(tmp_path / "log"))
    query_log.append(source(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    q = query_log.trending_windows(source()).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("trend").agg(F.sum("hits")).first()[0] == 7


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text('title,url\n"A, b",u\n')
    (tmp_path / "l.txt").write_text("  /wiki/A\n\nundefined\n")
    assert tables.csv_table(spark, str(tmp_path / "r.csv")).first()["title"] == "A, b"
    assert tables.text_lines(spark, str(tmp_path / "l.txt")).count() == 2
    tables.write_json_lines(spark.range(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_search_takes_whole_items(spark, sf):
    from seekline.plans import core_queries

    row = core_queries.search(spark, sf).selectExpr("max(size(split(corrected, ' '))) as words").first()
    assert row["words"] > 20
