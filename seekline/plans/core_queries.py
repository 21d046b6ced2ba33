"""Queries on index, retrieval, ranking, graph, text and analytics, each over its whole tables, and their SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, INDEX_STOP_WORDS, NAMESPACES, NAVIGATIONAL_WORDS, SPELL_STOP_WORDS, TECHNICAL_WORDS
from seekline.functions import text as tx
from seekline.functions.edit import osa_distance
from seekline.functions.snippet import snippet as make_snippet
from seekline.operators import analytics, ann, answer, bm25, graph, html, hybrid, index, spell, suggest, vectors
from seekline.plans.engine import Engine
from seekline.plans.lineage import folder, materialize
from seekline.sources import tables
from seekline.sources.tables import table
from seekline.streaming import live_index, query_log

TERMS = ["harbour", "glacier", "treaty"]
PREFIX = "ka"
AS_OF = "2024-01-01 00:00:00"
ROUNDS = 10


def _docs(spark, base):
    return table(spark, base, "documents").select("doc_id", "url", "title", "content")


def _one_query(spark, terms=TERMS):
    return spark.range(1).select(F.col("id").alias("query_id"), F.array(*map(F.lit, terms)).alias("terms"))


def _items(spark, base):
    """The test items as a workload: all tokens of each."""
    return table(spark, base, "eval_items").select(F.col("item_id").alias("query_id"), tx.query_tokens(F.col("text")).alias("terms"))


_indexes: dict[tuple[str, str], tuple] = {}


def stored_index(spark, base):
    """Postings in the order of their terms, lengths, statistics and link scores of a folder's documents, written once a session as a service does when it starts."""
    key = spark.sparkContext.applicationId, base
    if key not in _indexes:
        docs = _docs(spark, base)
        posts = materialize(index.postings(docs).repartitionByRange("term").sortWithinPartitions("term"), "postings")
        scores = materialize(graph.latest_scores(table(spark, base, "pagerank")), "scores")
        _indexes[key] = posts, materialize(index.doc_lengths(docs), "lengths"), materialize(index.corpus_stats(docs), "stats"), scores
    return _indexes[key]


def _bm25(spark, base, queries, terms=None):
    """``terms`` are those of all queries where they are a few: the scan then reads the files that hold them."""
    posts, lengths, stats, _ = stored_index(spark, base)
    return bm25.score(queries, posts if terms is None else posts.where(F.col("term").isin(terms)), lengths, stats)


def _top(df, score, k=10):
    at = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return df.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def tokens(spark, base):
    return index.tokens(_docs(spark, base)).groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("n"))


def term_freq(spark, base):
    return index.postings(_docs(spark, base))


def doc_freq(spark, base):
    return index.doc_frequencies(index.postings(_docs(spark, base)))


def corpus_stats(spark, base):
    return index.corpus_stats(_docs(spark, base)).select("n", F.round("avgdl", 6).alias("avgdl"))


def doc_length(spark, base):
    return index.doc_lengths(_docs(spark, base))


def idf(spark, base):
    docs = _docs(spark, base)
    df = index.doc_frequencies(index.postings(docs)).crossJoin(F.broadcast(index.corpus_stats(docs)))
    return df.select("term", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def bm25_top10(spark, base):
    scored = _bm25(spark, base, _one_query(spark), TERMS).withColumn("score", F.round("score", 6))
    return _top(scored, "score").select("rank", "doc_id", "score")


def bm25_multi_query(spark, base):
    scored = _bm25(spark, base, _items(spark, base)).withColumn("score", F.round("score", 6))
    return _top(scored, "score").select("query_id", "rank", "doc_id", "score")


def postings_json(spark, base):
    return index.to_json(index.postings(_docs(spark, base)))


def _delivery(spark, base):
    """The stored index, and what a second crawl of the German pages delivers: they have lost their content, so most of their terms are gone."""
    stored = index.from_json(table(spark, base, "inverted_index"))
    again = table(spark, base, "documents").where("lower(lang) like 'de%'").select("doc_id", "title", F.lit("").alias("content"))
    return stored, index.postings(again).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


def postings_merge(spark, base):
    return index.merge(*_delivery(spark, base))


def postings_merge_replace(spark, base):
    return index.merge(*_delivery(spark, base), replace_docs=True)


def postings_merge_json(spark, base):
    stored, new = _delivery(spark, base)
    return index.merge_json(index.to_json(stored), index.to_json(new))


def stored_postings(spark, base):
    return index.from_json(table(spark, base, "inverted_index"))


def spell_dictionary(spark, base):
    return index.dictionary(index.from_json(table(spark, base, "inverted_index")))


def _embeddings(spark, base):
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _knn_first(spark, base, k):
    rows = _embeddings(spark, base)
    asked = rows.where("doc_id = 0").select(F.lit(0).cast("long").alias("query_id"), "vector")
    return vectors.knn(asked, rows, k).select("rank", F.col("doc_id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def knn_top50(spark, base):
    return _knn_first(spark, base, 50)


def knn_top5(spark, base):
    return _knn_first(spark, base, 5)


def knn_multi(spark, base):
    """Every vector whose identifier is divisible by 50, against all."""
    rows = _embeddings(spark, base)
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return vectors.knn(asked, rows, 10).select("query_id", "rank", F.col("doc_id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def minmax_norm(spark, base):
    scored = _bm25(spark, base, _one_query(spark), TERMS)
    return scored.select("doc_id", F.round(hybrid.min_max(F.col("score"), "query_id"), 6).alias("norm"))


def _document_vectors(spark, base):
    return table(spark, base, "documents").where("size(vector) = 384").select("doc_id", "vector")


def _hybrid(spark, base, queries, asked, terms=None):
    scored = _bm25(spark, base, queries, terms)
    near = vectors.knn(asked, _document_vectors(spark, base), DEFAULTS.knn_depth).select("query_id", "doc_id", "similarity")
    return hybrid.rank(scored, near, _docs(spark, base), stored_index(spark, base)[3])


def hybrid_top10(spark, base):
    rows = _document_vectors(spark, base)
    asked = rows.where(F.exists("vector", lambda x: x != 0)).orderBy("doc_id").limit(1).select(F.lit(0).cast("long").alias("query_id"), "vector")
    return _hybrid(spark, base, _one_query(spark), asked, TERMS).select("rank", "doc_id", "bm25", "vector", "pagerank", "final")


def hybrid_multi(spark, base):
    """Each test item's words with the vector of the document of the same number, where there is one."""
    items = _items(spark, base)
    asked = _document_vectors(spark, base).join(items.select(F.col("query_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("query_id"), "vector")
    return _hybrid(spark, base, items, asked).select("query_id", "rank", "doc_id", "bm25", "vector", "pagerank", "final")


def links(spark, base):
    return graph.edges(table(spark, base, "links"))


def link_nodes(spark, base):
    return graph.nodes(graph.edges(table(spark, base, "links")), table(spark, base, "documents"))


def out_degree(spark, base):
    return graph.out_degrees(graph.edges(table(spark, base, "links")))


def dangling(spark, base):
    e = graph.edges(table(spark, base, "links"))
    return graph.dangling(graph.nodes(e, table(spark, base, "documents")), e)


def pagerank_links(spark, base):
    """Ten synchronous rounds over the link graph."""
    got, _ = graph.pagerank(table(spark, base, "links"), table(spark, base, "documents"), fixed_rounds=ROUNDS)
    return got.select("url", F.round("score", 9).alias("score"))


def pagerank_converged(spark, base):
    """Rounds until the ranks move by less than 1e-6 in sum, and the scores then."""
    got, rounds = graph.pagerank(table(spark, base, "links"), table(spark, base, "documents"))
    return got.select("url", F.round("score", 9).alias("score"), F.lit(rounds).alias("rounds"))


def scores_upsert(spark, base):
    """The stored scores after a run whose scores are each source page's share of the distinct edges."""
    e = graph.edges(table(spark, base, "links"))
    fresh = graph.out_degrees(e).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("all")))).select(F.col("source_url").alias("url"), (F.col("out_degree") / F.col("all")).alias("score"))
    return graph.upsert_scores(table(spark, base, "pagerank"), fresh).select("url", F.round("score", 12).alias("score"))


def latest_pagerank(spark, base):
    return graph.latest_scores(table(spark, base, "pagerank"))


def _roots(spark, base):
    """The page with the most outgoing edges, the smaller url on equal numbers."""
    return graph.out_degrees(graph.edges(table(spark, base, "links"))).orderBy(F.desc("out_degree"), "source_url").limit(1).select(F.col("source_url").alias("url"))


def bfs_levels(spark, base):
    return graph.bfs(table(spark, base, "links"), _roots(spark, base))


def unvisited_links(spark, base):
    return graph.unvisited(graph.edges(table(spark, base, "links")), table(spark, base, "documents"))


def query_tokens(spark, base):
    return table(spark, base, "query_log").where("query_text is not null").select("id", F.explode(tx.query_tokens(F.col("query_text"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))


def intent(spark, base):
    return table(spark, base, "query_log").where("query_text is not null").select("id", tx.classify_intent(F.col("query_text")).alias("intent"))


def expand_terms(spark, base):
    """Query texts with one synonym phrase from a fixed table."""
    log = table(spark, base, "query_log").where("query_text is not null")
    phrases = F.when(F.lower("query_text").contains("history"), F.array(F.lit("past of"), F.lit("chronicle")))
    return log.select("id", F.array_join(tx.expand_terms(F.col("query_text"), phrases), " ").alias("terms"))


def highlight(spark, base):
    return _docs(spark, base).where("title is not null").select("doc_id", tx.highlight(F.col("title"), ["ar", "Graph"]).alias("marked"))


def snippet_prefix(spark, base):
    """Snippets where no term is asked for: the beginning of the content."""
    none = F.array().cast("array<string>")
    return _docs(spark, base).select("doc_id", make_snippet("content", none).alias("snippet"))


def snippets(spark, base):
    return _docs(spark, base).select("doc_id", make_snippet("content", F.array(*map(F.lit, TERMS))).alias("snippet"))


def strip_tags(spark, base):
    return _docs(spark, base).where("title is not null").select("doc_id", tx.strip_tags(F.concat(F.lit("<mark>"), F.col("title"), F.lit("</mark> <b>x</b>"))).alias("plain"))


def parse_answer(spark, base):
    got = tx.parse_answer(F.concat(F.coalesce("title", F.lit("none")), F.lit(" is here.\nSources: One. Two! "), F.col("url")))
    return _docs(spark, base).select("doc_id", got["answer"].alias("answer"), F.array_join(got["sentences"], "|").alias("sentences"))


def _summaries(spark, base, terms):
    docs = _docs(spark, base).where("title is not null and length(content) > 0")
    asked = docs.select(F.col("doc_id").alias("query_id"), tx.classify_intent(F.col("title")).alias("intent"))
    results = docs.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), "title", make_snippet("content", terms).alias("snippet"))
    return answer.summarize(asked, results).select("query_id", "reason", "answer")


def summaries(spark, base):
    """Each title as a query that its own page answers, by the snippet around the title's words."""
    return _summaries(spark, base, tx.query_tokens(F.col("title")))


def summaries_plain(spark, base):
    """The same by snippets without a term, which begin where the content does."""
    return _summaries(spark, base, F.array().cast("array<string>"))


def suggest_prefix(spark, base):
    return suggest.suggest(suggest.titles(_docs(spark, base)), PREFIX)


def suggest_many(spark, base):
    prefixes = _docs(spark, base).where("title is not null").select(F.substring(F.lower("title"), 1, 3).alias("prefix")).distinct()
    return suggest.suggest_many(suggest.titles(_docs(spark, base)), prefixes)


def title_dedupe(spark, base):
    return suggest.titles(_docs(spark, base))


def top_queries(spark, base):
    return analytics.top_queries(table(spark, base, "query_log"))


def zero_results(spark, base):
    return analytics.zero_results(table(spark, base, "query_log"))


def avg_top_score(spark, base):
    return analytics.average_top_score(table(spark, base, "query_log")).select(F.round("avg_top_score", 6).alias("avg_top_score"))


def score_buckets(spark, base):
    return analytics.score_buckets(table(spark, base, "query_log"))


def bucket_share(spark, base):
    return analytics.bucket_shares(table(spark, base, "query_log")).select("bucket", "n", F.round("share", 6).alias("share"))


def hit_ratio(spark, base):
    return analytics.hit_ratios(table(spark, base, "query_log")).select("query_text", "hits", F.round("ratio", 6).alias("ratio"))


def corpus_counts(spark, base):
    docs = _docs(spark, base)
    return analytics.corpus_counts(docs, index.postings(docs))


def trending_7d(spark, base):
    log = table(spark, base, "query_log")
    return analytics.trending(log, AS_OF).select("query_text", "hits")


def history(spark, base):
    e = table(spark, base, "events").select("user_id", F.concat("event_type", F.lit("-"), F.get_json_object("props", "$.k")).alias("text"), "ts")
    return analytics.history(e, "user_id", "text", "ts")


def crumb(spark, base):
    return _docs(spark, base).select("doc_id", tx.breadcrumb(F.col("url")).alias("crumb"))


def zoom(spark, base):
    """Boxes made of the embeddings' first entries."""
    e = table(spark, base, "embeddings")
    wide = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 40)
    return e.select("vec_id", tx.zoom(wide).alias("zoom"))


def pending_vectors(spark, base):
    return table(spark, base, "documents").agg(F.count_if(F.col("vector").isNull()).alias("pending"), F.count("vector").alias("done"))


def embed_text(spark, base):
    return _docs(spark, base).select("doc_id", vectors.embedding_text().alias("text"))


def embed_pending(spark, base):
    """Vectors for the documents that have none, by the hashing stand-in: their entries other than 0."""
    docs = table(spark, base, "documents").where("vector is null").select("doc_id", "title", "content")
    got = vectors.embed(docs, functools.partial(vectors.hash_embedder, DEFAULTS.dimension))
    return got.select("doc_id", F.posexplode("vector").alias("place", "x")).where("x <> 0").select("doc_id", "place", F.round(F.col("x").cast("double"), 5).alias("weight"))


def pending_page(spark, base):
    """The page of documents to be embedded next after the first pending one."""
    docs = table(spark, base, "documents")
    done = docs.where("vector is not null").select("doc_id")
    first = vectors.pending(docs, done).agg(F.min("doc_id")).first()[0]
    return vectors.pending_page(docs.select("doc_id", "title"), done, after=first).select("doc_id", "title")


def vectors_stored(spark, base):
    """The vectors' dimensions after the pending documents were embedded and stored by key."""
    docs = table(spark, base, "documents")
    fresh = vectors.embed(docs.where("vector is null").select("doc_id", "title", "content"), functools.partial(vectors.hash_embedder, DEFAULTS.dimension))
    return vectors.store(docs.where("vector is not null").select("doc_id", "vector"), fresh).select("doc_id", F.size("vector").alias("dimension"))


def doc_by_url(spark, base):
    """The rows of the url that most links name."""
    best = graph.edges(table(spark, base, "links")).join(_docs(spark, base).select(F.col("url").alias("target_url")).distinct(), "target_url", "left_semi").groupBy("target_url").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target_url").first()
    return tables.by_url(_docs(spark, base), best["target_url"] if best else "").select("doc_id", "url", "title")


def docs_page(spark, base):
    """The fourth page of 25 documents by identifier, each page going on behind the last key of the one before."""
    docs, after = _docs(spark, base), None
    for _ in range(3):
        last = tables.page(docs.select("doc_id"), "doc_id", 25, after).agg(F.max("doc_id")).first()[0]
        after = last if last is not None else after
    return tables.page(docs, "doc_id", 25, after).select("doc_id", "url")


def stream_index(spark, base):
    """The live index after all documents came as events, one delivery for each time a url was stored again."""
    docs = table(spark, base, "documents").where("length(url) > 0 and length(title) > 0 and length(content) > 0")
    at = Window.partitionBy("url").orderBy("doc_id")
    docs = materialize(docs.select("url", "title", "content", "created_at", F.row_number().over(at).alias("delivery")), "events")
    root = f"{folder(spark)}/live-{uuid.uuid4().hex}"
    live = live_index.LiveIndex(spark, f"{root}/index")
    for (k,) in sorted(docs.select("delivery").distinct().collect()):  # as many as the most often stored url has rows
        tables.publish(docs.where(F.col("delivery") == k), f"{root}/events")
        live.start(live_index.complete_events(live_index.read_events(spark, f"{root}/events")), f"{root}/checkpoint").awaitTermination()
    return live.postings().join(live.documents().select("doc_id", "url"), "doc_id").select("url", "term", "tf")


def vector_literals(spark, base):
    """Vectors in thousandths as text."""
    return _embeddings(spark, base).select("doc_id", vectors.vector_literal(F.transform("vector", lambda x: F.round(x.cast("double") * 1000).cast("int"))).alias("literal"))


def stream_trending(spark, base):
    """The query log as a stream, counted over windows of seven days that begin each day."""
    root = f"{folder(spark)}/trending-{uuid.uuid4().hex}"
    log = table(spark, base, "query_log").select("query_text", "searched_at")
    log.write.parquet(f"{root}/log")
    rows = spark.readStream.schema(log.schema).parquet(f"{root}/log")
    query_log.keep_windows(query_log.trending_windows(rows), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").select(F.unix_seconds("begins").alias("begins"), "query_text", "hits", F.unix_micros("latest").alias("latest"))


def ann_lsh(spark, base):
    """Approximate join of unit vectors: pairs at Euclidean distance below 1.2 found by shared buckets."""
    model, rows = vectors.lsh_index(_embeddings(spark, base))
    asked = rows.where("doc_id % 50 = 0")
    if model is None:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double")
    near = model.approxSimilarityJoin(asked, rows, 1.2, "distance")
    return near.select(F.col("datasetA.doc_id").alias("query_id"), F.col("datasetB.doc_id").alias("vec_id"), (1 - F.col("distance") ** 2 / 2).alias("similarity")).where("query_id <> vec_id")


def _stored_vectors(spark, base):
    return ann.StoredIndex(_document_vectors(spark, base), f"{folder(spark)}/ann-{uuid.uuid4().hex}", 384)


def ann_top5(spark, base):
    """About the five nearest of the first document with a usable vector, from the folders of its nearest lists."""
    stored = _stored_vectors(spark, base)
    first = stored.table.orderBy("doc_id").first()
    return stored.search_one(first["vector"] if first else [1.0] * 384, 5).select("doc_id", F.round("similarity", 5).alias("similarity"))


def ann_recall(spark, base):
    """Recall of the stored index at 10 for every vector whose identifier is divisible by 50, against the exact search."""
    stored = _stored_vectors(spark, base)
    asked = stored.table.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = vectors.knn(asked, stored.table, 10).groupBy("query_id").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("n"))
    found = stored.search(asked, 10).join(exact, "query_id").where(F.col("similarity") >= F.col("worst") - 1e-6)
    return exact.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("pairs")).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("found")))).withColumn("recall", F.round(F.col("found") / F.col("pairs"), 4))


def insert_if_absent(spark, base):
    """Scored urls that documents doesn't hold yet, each once."""
    new = table(spark, base, "pagerank").select("url").where("url is not null").distinct()
    return index.insert_if_absent(_docs(spark, base), new)


def clean_text(spark, base):
    return _docs(spark, base).where("content is not null").select("doc_id", F.md5(tx.clean_text(F.col("content"))).alias("digest"))


def clean_titles(spark, base):
    """Titles without the site's name behind a dash."""
    return _docs(spark, base).where("title is not null").select("doc_id", tx.clean_title(F.col("title"), "[A-Z][a-z]+(pedia|atlas|facts|lore|wiki)").alias("title"))


def page_text(spark, base):
    """Documents wrapped as pages and read back."""
    shell = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit(" - Wikipedia</title><style>p{}</style></head><body><div id=bodyContent><p>"), F.translate(F.coalesce("content", F.lit("")), "<>&", "   "), F.lit("</p><div class=navbox>x</div></div></body></html>"))
    return html.pages(_docs(spark, base).select("url", shell.alias("html"))).select("url", F.md5("text").alias("digest"))


def page_links(spark, base):
    """Edges written as anchors and found again."""
    e = graph.edges(table(spark, base, "links"))
    anchors = e.select("source_url", F.regexp_extract("target_url", r"^https?://[^/]+(/[^?]*)$", 1).alias("href")).groupBy("source_url").agg(F.array_sort(F.collect_set("href")).alias("hrefs"))
    raw = anchors.select(F.col("source_url").alias("url"), F.concat(F.lit("<body>"), F.array_join(F.transform("hrefs", lambda h: F.concat(F.lit('<a href="'), h, F.lit('">x</a>'))), ""), F.lit("</body>")).alias("html"))
    return html.page_links(html.pages(raw, None), "https://h")


def osa_pairs(spark, base):
    """Distances of each query's neighbouring words."""
    log = table(spark, base, "query_log").select(F.lower("query_text").alias("q")).distinct().select(tx.query_tokens(F.col("q")).alias("t")).where("size(t) > 1")
    pairs = log.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("a"), F.element_at("t", i + 1).alias("b")))).alias("p")).select("p.a", "p.b").distinct()
    return pairs.withColumn("distance", osa_distance("a", "b"))


def spell_correct(spark, base):
    """Corrections of the distinct query texts against the stored index."""
    texts = materialize(table(spark, base, "query_log").where("trim(query_text) <> ''").select("query_text").distinct(), "texts").withColumn("query_id", F.xxhash64("query_text"))
    return spell.correct(texts, materialize(spell_dictionary(spark, base), "dictionary")).select("original", "corrected", "was_changed")


def search(spark, base):
    """The whole pipeline for the test items' whole texts: correction, intent, ranking, snippets."""
    docs = _docs(spark, base)
    engine = Engine(docs, table(spark, base, "links"), _document_vectors(spark, base), scores=graph.latest_scores(table(spark, base, "pagerank")))
    asked = table(spark, base, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return engine.search(asked).select("query_id", "corrected", "intent", "rank", "doc_id", "snippet", F.col("scores.final").alias("final"))


QUERIES = {f.__name__: f for f in (
    tokens, term_freq, doc_freq, corpus_stats, doc_length, idf, bm25_top10, bm25_multi_query, postings_json, stored_postings, postings_merge, postings_merge_replace, postings_merge_json, spell_dictionary,
    knn_top50, knn_top5, knn_multi, minmax_norm, hybrid_top10, hybrid_multi, links, link_nodes, out_degree, dangling, pagerank_links, pagerank_converged, scores_upsert, latest_pagerank, bfs_levels,
    unvisited_links, query_tokens, intent, expand_terms, highlight, snippet_prefix, snippets, strip_tags, parse_answer, summaries, summaries_plain, suggest_prefix, suggest_many, title_dedupe, top_queries,
    zero_results, avg_top_score, score_buckets, bucket_share, hit_ratio, corpus_counts, trending_7d, history, crumb, zoom, pending_vectors, embed_text, embed_pending, pending_page, vectors_stored, doc_by_url, docs_page, stream_index, stream_trending, vector_literals, ann_lsh, ann_top5, ann_recall,
    insert_if_absent, clean_text, clean_titles, page_text, page_links, osa_pairs, spell_correct, search,
)}

# ---- SQL ----
_SPELL_STOP = ", ".join(f"'{w}'" for w in SPELL_STOP_WORDS)
_STOP = ", ".join(f"'{w}'" for w in INDEX_STOP_WORDS)
_TOKENS = f"""
raw as (
  select doc_id, 'title' as field, 2 as w, unnest(string_split_regex(coalesce(title, ''), '[^A-Za-z0-9]+')) as t from documents union all
  select doc_id, 'content', 1, unnest(string_split_regex(coalesce(content, ''), '[^A-Za-z0-9]+')) from documents),
toks as (select doc_id, field, w, lower(t) as term from raw where length(t) >= 2 and lower(t) not in ({_STOP})),
posts as (select term, doc_id, cast(sum(w) as bigint) as tf from toks group by 1, 2),
lens as (select doc_id, greatest(1, length(coalesce(title, '') || ' ' || coalesce(content, ''))) as len from documents),
stats as (select count(*) as n, avg(length(coalesce(title, '') || ' ' || coalesce(content, ''))) as avgdl from documents),
dfs as (select term, count(*) as df from posts group by 1)"""
_ITEMS = "items as (select item_id as query_id, regexp_extract_all(lower(text), '[a-z0-9]+') as terms from eval_items)"
_ONE = "items as (select 0 as query_id, ['harbour', 'glacier', 'treaty'] as terms)"


def _scored(items: str) -> str:
    return f"""with {_TOKENS}, {items},
asked as (select distinct query_id, unnest(terms) as term from items),
scored as (
  select a.query_id, p.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) as score
  from asked a join posts p on p.term = a.term join dfs d on d.term = a.term join lens l on l.doc_id = p.doc_id cross join stats group by 1, 2)"""


def _ranked(items: str, columns: str) -> str:
    return _scored(items) + f", r as (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from scored) select {columns} from r where rank <= 10"


_USABLE = "docv as (select doc_id, cast(vector as double[]) as v from documents where len(vector) = 384 and list_sum(list_transform(vector, lambda x: abs(x))) > 0)"
_LATEST = "latest as (select url, arg_max(score, (coalesce(updated_at, timestamptz '1970-01-01 00:00:00+00'), score)) as score from pagerank where url is not null and score is not null group by url)"


def _hybrid_sql(items: str, vectors_: str, columns: str) -> str:
    return _hybrid_ctes(items, vectors_) + f" select {columns} from r where rank <= 10"


def _hybrid_ctes(items: str, vectors_: str) -> str:
    return _scored(items) + f""", {_USABLE}, {_LATEST}, qv as ({vectors_}),
sims as (select q.query_id, d.doc_id, round(list_cosine_similarity(q.v, d.v), 12) as similarity from qv q cross join docv d),
near as (select * from (select *, row_number() over (partition by query_id order by similarity desc, doc_id) as k from sims) where k <= 50),
t as (select query_id, doc_id, case when max(score) over w = min(score) over w then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as bm25 from scored window w as (partition by query_id)),
v as (select query_id, doc_id, case when max(similarity) over w = min(similarity) over w then 0 else (similarity - min(similarity) over w) / (max(similarity) over w - min(similarity) over w) end as vector from near window w as (partition by query_id)),
c as (select coalesce(t.query_id, v.query_id) as query_id, coalesce(t.doc_id, v.doc_id) as doc_id, coalesce(bm25, 0) as bm25, coalesce(vector, 0) as vector from t full join v on t.query_id = v.query_id and t.doc_id = v.doc_id),
p as (select c.*, coalesce(l.score, 0) as pr from c join documents d on d.doc_id = c.doc_id left join latest l on l.url = d.url),
s as (select query_id, doc_id, bm25, vector, case when max(pr) over w = min(pr) over w then 0 else (pr - min(pr) over w) / (max(pr) over w - min(pr) over w) end as pagerank from p window w as (partition by query_id)),
f as (select query_id, doc_id, round(bm25, 4) as bm25, round(vector, 4) as vector, round(pagerank, 4) as pagerank, round(0.4 * bm25 + 0.4 * vector + 0.2 * pagerank, 4) as final from s),
r as (select *, row_number() over (partition by query_id order by final desc, doc_id) as rank from f)"""


_EDGES = "edges as (select distinct source_url, target_url from links where trim(source_url) <> '' and trim(target_url) <> '')"
_NODES = _EDGES + ", nodes as (select source_url as url from edges union select target_url from edges union select url from documents where url is not null)"


def _pagerank_sql() -> str:
    parts = [f"with {_NODES}, n as (select count(*) as n from nodes), deg as (select source_url, count(*) as d from edges group by 1), r0 as (select url, 1.0::double / n as score from nodes, n)"]
    for i in range(ROUNDS):
        parts.append(
            f"loose{i} as (select coalesce(sum(score), 0) as s from r{i} where url not in (select source_url from edges)), "
            f"given{i} as (select target_url as url, sum(score / d) as s from edges join r{i} on r{i}.url = source_url join deg using (source_url) group by 1), "
            f"r{i + 1} as materialized (select r{i}.url, 0.15 / n + 0.85 * loose{i}.s / n + 0.85 * coalesce(given{i}.s, 0) as score from r{i} left join given{i} using (url) cross join n cross join loose{i})"
        )
    return ", ".join(parts) + f" select url, round(score, 9) as score from r{ROUNDS}"


def _converged_sql(most: int = DEFAULTS.max_iterations) -> str:
    parts = [f"with {_NODES}, n as (select count(*) as n from nodes), deg as (select source_url, count(*) as d from edges group by 1), r0 as materialized (select url, 1.0::double / n as score from nodes, n)"]
    for i in range(most):
        parts.append(
            f"loose{i} as (select coalesce(sum(score), 0) as s from r{i} where url not in (select source_url from edges)), "
            f"given{i} as (select target_url as url, sum(score / d) as s from edges join r{i} on r{i}.url = source_url join deg using (source_url) group by 1), "
            f"r{i + 1} as materialized (select r{i}.url, 0.15 / n + 0.85 * loose{i}.s / n + 0.85 * coalesce(given{i}.s, 0) as score from r{i} left join given{i} using (url) cross join n cross join loose{i})"
        )
    parts.append("moves as (" + " union all ".join(f"select {i + 1} as round, sum(abs(a.score - b.score)) as moved from r{i + 1} a join r{i} b using (url)" for i in range(most)) + ")")
    parts.append(f"last as (select coalesce(min(round) filter (moved < 1e-6), {most}) as round from moves)")
    every = " union all ".join(f"select {i + 1} as round, url, score from r{i + 1}" for i in range(most))
    return ", ".join(parts) + f" select url, round(score, 9) as score, cast(round as int) as rounds from ({every}) where round = (select round from last)"


def _knn_sql(where: str, k: int, columns: str) -> str:
    return f"""with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
s as (select q.vec_id as query_id, d.vec_id, round(list_cosine_similarity(q.e, d.e), 12) as x from v q cross join v d where {where}),
r as (select query_id, vec_id, round(x, 5) as similarity, row_number() over (partition by query_id order by x desc, vec_id) as rank from s) select {columns} from r where rank <= {k}"""


_STORED = r"""whole as (select trim(lower(term)) as term, postings from inverted_index where trim(term) <> '' and postings is not null and json_valid(postings)),
entries as (select term, unnest(json_keys(postings)) as k, postings from whole),
stored as (select term, cast(k as bigint) as doc_id, max(cast(json_extract_string(postings, '$."' || k || '"') as bigint)) as tf from entries group by 1, 2)"""
_DELIVERY = _STORED + f""", redelivered as (select doc_id, unnest(string_split_regex(coalesce(title, ''), '[^A-Za-z0-9]+')) as t from documents where lower(lang) like 'de%'),
again as (select lower(t) as term, doc_id, cast(2 * count(*) as bigint) as tf from redelivered where length(t) >= 2 and lower(t) not in ({_STOP}) group by 1, 2)"""
_ANY = lambda words: "(" + " or ".join(f"contains(lower(query_text), '{w}')" for w in words) + ")"
_B = lambda i: f"sum(case when top_score >= {i / 5} and top_score {'<=' if i == 4 else '<'} {(i + 1) / 5} then 1 else 0 end)"
_BUCKETS = "select " + ", ".join(f"cast({_B(i)} as bigint) as b{i}" for i in range(5)) + " from query_log"
_TITLES = "titles as (select lower(title) as folded, max(title) as title from documents where title is not null and title <> '' group by 1)"
_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\n\\t]+', ' ', 'g'), '{_BLANK}{{2,}}', ' ', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

def _snippet_sql(source: str) -> str:
    """CTEs up to ``snips`` (id, snippet) of a relation (id, content, terms) whose terms are of letters and digits."""
    space = _BLANK[1:-1]
    return f"""src as (select id, coalesce(content, '') as c, case when len(terms) > 0 then '(?i)(' || array_to_string(terms, '|') || ')' end as pat from ({source})),
cut as (select *, string_split_regex(c, pat) as p, regexp_extract_all(c, pat) as m from src where pat is not null and c <> ''),
hit as (select *, list_transform(range(1, len(p)), lambda i: cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint)) as h from cut),
win as (select *, list_transform(h, lambda x: greatest(0, x - 100)) as starts from hit),
num as (select *, list_transform(starts, lambda s: len(list_filter(h, lambda x: x >= s and x < s + 200))) as counts from win),
places as (select id, c, pat, coalesce(starts[list_position(counts, list_max(counts))], 0) as a from num),
ends as (select *, least(length(c), a + 200) as z from places),
snap as (select id, c, pat, a - length(regexp_extract(substr(c, 1, a), '[^{space}]*$')) as a, z + length(regexp_extract(substr(c, z + 1), '^[^{space}]*')) as z from ends),
snips as (select id, case when a > 0 then '...' else '' end || regexp_replace(regexp_replace(substr(c, a + 1, z - a), '^{_BLANK}+|{_BLANK}+$', '', 'g'), pat, '<mark>\\1</mark>', 'g') || case when z < length(c) then '...' else '' end as snippet from snap
  union all select id, case when length(c) > 200 then substr(c, 1, 200) || '...' else c end from src where pat is null or c = '')"""


# From texts (query_text) and dict (term, freq, len) to done (query_text, corrected).
_SPELLED = f"""pieces as (select query_text, unnest(p) as piece, generate_subscripts(p, 1) as pos from (select query_text, regexp_extract_all(query_text, '[A-Za-z0-9]+|\\s+|[^A-Za-z0-9\\s]+') as p from texts)),
words as (select distinct lower(piece) as word from pieces where regexp_matches(piece, '^[A-Za-z]+$') and length(piece) >= 4 and lower(piece) not in ({_SPELL_STOP})),
like_words as (select word as a, term as b from words join dict on abs(length(word) - len) <= 2 and word <> term and levenshtein(word, term) <= 4),
d(a, b, i, two, one) as (select a, b, 0, cast([] as bigint[]), range(0, length(b) + 1) from like_words union all
  select a, b, i + 1, one, list_transform(range(0, length(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: case when k = 0 then i + 1 else least(
    one[k + 1] + 1, one[k] + case when a[i + 1] = b[k] then 0 else 1 end,
    case when i > 0 and k > 1 and a[i + 1] = b[k - 1] and a[i] = b[k] then two[k - 1] + 1 else 1000 end) end - k))) from d where i < length(a)),
dist as (select a as word, b as term, one[length(b) + 1] as distance from d where i = length(a) and one[length(b) + 1] <= 2),
best as (select word, term, freq from (select word, dist.term, freq, row_number() over (partition by word order by distance, freq desc, length(dist.term), dist.term) as k from dist join dict on dict.term = dist.term) where k = 1),
fixes as (select b.word, b.term from best b left join dict o on o.term = b.word where o.term is null or b.freq >= 10 * o.freq),
done as (select query_text, string_agg(coalesce(f.term, piece), '' order by pos) as corrected from pieces p left join fixes f on f.word = lower(p.piece) and regexp_matches(p.piece, '^[A-Za-z]+$') and length(p.piece) >= 4 and lower(p.piece) not in ({_SPELL_STOP}) group by 1)"""


def _search_sql() -> str:
    items = f"""dict as (select term, cast(sum(tf) as bigint) as freq, length(term) as len from posts group by 1 having sum(tf) > 0),
texts as (select distinct text as query_text from eval_items where trim(text) <> ''), {_SPELLED},
wanted as (select item_id as query_id, corrected, regexp_extract_all(lower(corrected), '[a-z0-9]+') as terms from eval_items join done on query_text = text),
items as (select query_id, terms from wanted)"""
    ranked = _hybrid_ctes(items, "select cast(0 as bigint) as query_id, v from docv where false").replace("with ", "with recursive ", 1)
    distinct = "list_filter(list_transform(range(1, len(terms) + 1), lambda i: case when list_position(terms, terms[i]) = i then terms[i] end), lambda x: x is not null)"
    shown = _snippet_sql(f"select query_id * 100 + rank as id, content, {distinct} as terms from hits join wanted using (query_id) join documents using (doc_id)")
    intent = f"case when {_ANY(NAVIGATIONAL_WORDS).replace('query_text', 'corrected')} or regexp_matches(corrected, '\\b[A-Z][a-z]+\\s+[A-Z][a-z]+') then 'navigational' when {_ANY(TECHNICAL_WORDS).replace('query_text', 'corrected')} then 'technical' else 'informational' end"
    return f"""{ranked}, hits as (select query_id, rank, doc_id, final from r where rank <= 10), {shown}
select query_id, corrected, {intent} as intent, cast(rank as int) as rank, doc_id, snippet, final from hits join wanted using (query_id) join snips on id = query_id * 100 + rank"""


def _summaries_sql(snippets: str) -> str:
    """The answers of documents with a title and content, by CTEs that end with ``snips``."""
    return f"""with {snippets},
i as (select id, title, snippet, case when {_ANY(NAVIGATIONAL_WORDS).replace("query_text", "title")} or regexp_matches(title, '\\b[A-Z][a-z]+\\s+[A-Z][a-z]+') then 'skipped_navigational' end as reason from snips join documents on doc_id = id)
select id as query_id, reason, case when reason is null then {_TRIM("regexp_extract('[1] ' || title || ': ' || regexp_replace(snippet, '<[^>]+>', '', 'g'), '^\\[1\\] [^\\n]*?: ([^\\n]*)', 1)")} end as answer from i"""


_TITLED = "select doc_id as id, content, {} as terms from documents where title is not null and length(content) > 0"
_TITLE_WORDS = "list_filter(list_transform(range(1, len(t) + 1), lambda i: case when list_position(t, t[i]) = i then t[i] end), lambda x: x is not null)"

SQL = {
    "snippets": f"with {_snippet_sql(f'select doc_id as id, content, {TERMS} as terms from documents')} select id as doc_id, snippet from snips",
    "summaries": _summaries_sql(_snippet_sql(f"select id, content, {_TITLE_WORDS} as terms from (" + _TITLED.format("1").replace("1 as terms", "regexp_extract_all(lower(title), '[a-z0-9]+') as t") + ")")),
    "summaries_plain": _summaries_sql(_snippet_sql(_TITLED.format("cast([] as varchar[])"))),
    "tokens": f"with {_TOKENS} select doc_id, field, term, count(*) as n from toks group by 1, 2, 3",
    "term_freq": f"with {_TOKENS} select term, doc_id, tf from posts",
    "doc_freq": f"with {_TOKENS} select term, df from dfs",
    "corpus_stats": f"with {_TOKENS} select n, round(avgdl, 6) as avgdl from stats",
    "doc_length": f"with {_TOKENS} select doc_id, cast(len as int) as len from lens",
    "idf": f"with {_TOKENS} select term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) as idf from dfs, stats",
    "bm25_top10": _ranked(_ONE, "cast(rank as int) as rank, doc_id, score"),
    "bm25_multi_query": _ranked(_ITEMS, "query_id, cast(rank as int) as rank, doc_id, score"),
    "postings_json": f"""with {_TOKENS} select term, '{{' || string_agg('"' || doc_id || '":' || tf, ',' order by doc_id) || '}}' as postings from posts group by 1""",
    "stored_postings": f"with {_STORED} select term, doc_id, tf from stored",
    "postings_merge": f"with {_DELIVERY} select coalesce(p.term, s.term) as term, coalesce(p.doc_id, s.doc_id) as doc_id, coalesce(p.tf, s.tf) as tf from again p full join stored s on s.term = p.term and s.doc_id = p.doc_id",
    "postings_merge_replace": f"with {_DELIVERY} select term, doc_id, tf from again union all select term, doc_id, tf from stored where doc_id not in (select doc_id from again)",
    "postings_merge_json": f"""with {_DELIVERY}, m as (select coalesce(p.term, s.term) as term, coalesce(p.doc_id, s.doc_id) as doc_id, coalesce(p.tf, s.tf) as tf from again p full join stored s on s.term = p.term and s.doc_id = p.doc_id)
select term, '{{' || string_agg('"' || doc_id || '":' || tf, ',' order by doc_id) || '}}' as postings from m group by 1""",
    "spell_dictionary": f"with {_STORED} select term, cast(sum(tf) as bigint) as freq, cast(length(term) as int) as len from stored group by 1 having sum(tf) > 0",
    "knn_top50": _knn_sql("q.vec_id = 0", 50, "cast(rank as int) as rank, vec_id, similarity"),
    "knn_top5": _knn_sql("q.vec_id = 0", 5, "cast(rank as int) as rank, vec_id, similarity"),
    "knn_multi": _knn_sql("q.vec_id % 50 = 0", 10, "query_id, cast(rank as int) as rank, vec_id, similarity"),
    "minmax_norm": _scored(_ONE) + " select doc_id, round((score - (select min(score) from scored)) / (select max(score) - min(score) from scored), 6) as norm from scored",
    "hybrid_top10": _hybrid_sql(_ONE, "select 0 as query_id, v from docv order by doc_id limit 1", "cast(rank as int) as rank, doc_id, bm25, vector, pagerank, final"),
    "hybrid_multi": _hybrid_sql(_ITEMS, "select i.query_id, v from items i join docv on docv.doc_id = i.query_id", "query_id, cast(rank as int) as rank, doc_id, bm25, vector, pagerank, final"),
    "links": f"with {_EDGES} select source_url, target_url from edges",
    "link_nodes": f"with {_NODES} select url from nodes",
    "out_degree": f"with {_EDGES} select source_url, count(*) as out_degree from edges group by 1",
    "dangling": f"with {_NODES} select url from nodes where url not in (select source_url from edges)",
    "pagerank_links": _pagerank_sql(),
    "latest_pagerank": f"with {_LATEST} select url, score from latest",
    "bfs_levels": f"""with recursive {_EDGES}, root as (select source_url as url from edges group by 1 order by count(*) desc, 1 limit 1),
b as (select url, 0 as level from root union select e.target_url, b.level + 1 from b join edges e on e.source_url = b.url where b.level < 25) select url, cast(min(level) as int) as level from b group by 1""",
    "unvisited_links": f"with {_EDGES} select distinct target_url as url from edges where target_url not in (select url from documents where url is not null)",
    "query_tokens": "with t as (select id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as token from query_log where query_text is not null) select id, token, count(*) as n from t group by 1, 2",
    "intent": f"select id, case when {_ANY(NAVIGATIONAL_WORDS)} or regexp_matches(query_text, '\\b[A-Z][a-z]+\\s+[A-Z][a-z]+') then 'navigational' when {_ANY(TECHNICAL_WORDS)} then 'technical' else 'informational' end as intent from query_log where query_text is not null",
    "highlight": "select doc_id, regexp_replace(title, '(ar|graph)', '<mark>\\1</mark>', 'gi') as marked from documents where title is not null",
    "snippet_prefix": "select doc_id, case when coalesce(content, '') = '' then '' when length(content) > 200 then substr(content, 1, 200) || '...' else content end as snippet from documents",
    "strip_tags": "select doc_id, title || ' x' as plain from documents where title is not null",
    "parse_answer": f"select doc_id, {_TRIM('coalesce(title, $$none$$) || $$ is here.$$')} as answer, 'One.|Two!|' || url as sentences from documents",
    "suggest_prefix": f"with {_TITLES} select title, cast(length(title) as int) as len from titles where starts_with(folded, '{PREFIX}') order by len, title collate en, title limit 8",
    "suggest_many": f"""with {_TITLES}, pre as (select distinct trim(substr(lower(title), 1, 3)) as prefix from documents where title is not null),
r as (select p.prefix, t.title, row_number() over (partition by p.prefix order by length(t.title), t.title collate en, t.title) as rank from titles t join pre p on starts_with(t.folded, p.prefix) where p.prefix <> '')
select prefix, title, cast(rank as int) as rank from r where rank <= 8""",
    "title_dedupe": f"with {_TITLES} select folded, title, cast(length(title) as int) as len from titles",
    "top_queries": "select query_text, count(*) as hits from query_log group by 1 order by hits desc, query_text nulls first limit 10",
    "zero_results": "select count(*) as zero_result_count from query_log where result_count = 0",
    "avg_top_score": "select round(coalesce(avg(top_score), 0), 6) as avg_top_score from query_log",
    "score_buckets": _BUCKETS,
    "bucket_share": f"with b as ({_BUCKETS}), t as (select b0 + b1 + b2 + b3 + b4 as t from b) " + " union all ".join(f"select 'b{i}' as bucket, b{i} as n, round(b{i} / case when t = 0 then 1 else t end, 6) as share from b, t" for i in range(5)),
    "hit_ratio": "with t as (select query_text, count(*) as hits from query_log group by 1 order by hits desc, query_text nulls first limit 10) select query_text, hits, round(hits / (select max(hits) from t), 6) as ratio from t",
    "corpus_counts": f"with {_TOKENS} select (select count(*) from documents) as documents, (select count(*) from dfs) as terms",
    "trending_7d": f"select query_text, hits from (select query_text, count(*) as hits, max(searched_at) as latest from query_log where searched_at > timestamptz '{AS_OF}+00' - interval 7 day group by 1 order by hits desc, latest desc, query_text limit 6)",
    "history": """with e as (select user_id, event_type || '-' || json_extract_string(props, '$.k') as query_text, ts from events),
l as (select user_id, query_text, max(ts) as last from e where query_text is not null and user_id is not null group by 1, 2),
r as (select *, row_number() over (partition by user_id order by last desc, query_text) as rank from l) select user_id, query_text, cast(rank as int) as rank from r where rank <= 8""",
    "crumb": "select doc_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/', ' › ') as crumb from documents",
    "zoom": "with b as (select vec_id, abs(cast(embedding[2] as double) * 40 - cast(embedding[1] as double) * 40) as span from embeddings) select vec_id, case when span > 8 then 5 when span > 2 then 7 when span > 0.5 then 10 else 12 end as zoom from b",
    "pending_vectors": "select count(*) filter (vector is null) as pending, count(vector) as done from documents",
    "embed_text": "select doc_id, substr(coalesce(title, '') || ' ' || coalesce(content, ''), 1, 4000) as text from documents",
    "embed_pending": """with w as (select doc_id, md5(unnest(regexp_extract_all(lower(substr(coalesce(title, '') || ' ' || coalesce(content, ''), 1, 4000)), '[a-z0-9]+'))) as h from documents where vector is null),
p as (select doc_id, cast('0x' || substr(h, 1, 8) as bigint) % 384 as place, sum(case when substr(h, 9, 1) >= '8' then 1 else -1 end) as x from w group by 1, 2)
select doc_id, cast(place as int) as place, round(cast(cast(x / sqrt(sum(x * x) over (partition by doc_id)) as float) as double), 5) as weight from p where x <> 0""",
    "pending_page": "select doc_id, title from documents where vector is null and doc_id > (select min(doc_id) from documents where vector is null) order by doc_id limit 64",
    "vectors_stored": "select doc_id, cast(coalesce(len(vector), 384) as int) as dimension from documents",
    "doc_by_url": f"with {_EDGES}, best as (select target_url from edges where target_url in (select url from documents) group by 1 order by count(*) desc, 1 limit 1) select doc_id, url, title from documents where url in (select target_url from best)",
    "docs_page": "select doc_id, url from documents order by doc_id limit 25 offset 75",
    "stream_index": f"""with d as (select doc_id, url, title, content, row_number() over (partition by url order by doc_id desc) as k from documents where length(url) > 0 and length(title) > 0 and length(content) > 0),
raw as (select url, 2 as w, unnest(string_split_regex(title, '[^A-Za-z0-9]+')) as t from d where k = 1 union all select url, 1, unnest(string_split_regex(content, '[^A-Za-z0-9]+')) from d where k = 1)
select url, lower(t) as term, cast(sum(w) as bigint) as tf from raw where length(t) >= 2 and lower(t) not in ({_STOP}) group by 1, 2""",
    "vector_literals": "select vec_id as doc_id, replace(cast(list_transform(embedding, lambda x: cast(round(cast(x as double) * 1000) as int)) as varchar), ', ', ',') as literal from embeddings",
    "stream_trending": """with w as (select query_text, searched_at, unnest(range(7)) as k from query_log where searched_at is not null)
select cast(epoch(date_trunc('day', searched_at)) as bigint) - 86400 * k as begins, query_text, count(*) as hits, epoch_us(max(searched_at)) as latest from w group by 1, 2""",
    "spell_correct": f"with recursive {_STORED}, dict as (select term, cast(sum(tf) as bigint) as freq, length(term) as len from stored group by 1 having sum(tf) > 0), texts as (select distinct query_text from query_log where trim(query_text) <> ''), {_SPELLED} select query_text as original, corrected, corrected <> query_text as was_changed from done",
    "search": _search_sql(),
    "pagerank_converged": _converged_sql(),
    "scores_upsert": f"""with {_EDGES}, fresh as (select source_url as url, count(*) / (select count(*) from edges) as score from edges group by 1)
select url, round(score, 12) as score from pagerank where url is null or url not in (select url from fresh) union all select url, round(score, 12) from fresh""",
    "expand_terms": """with q as (select id, query_text, case when contains(lower(query_text), 'history') then ' past of chronicle' else '' end as more from query_log where query_text is not null),
t as (select id, unnest(w) as token, generate_subscripts(w, 1) as pos from (select id, regexp_extract_all(lower(query_text) || more, '[a-z0-9]+') as w from q)),
f as (select id, token, min(pos) as pos from t group by 1, 2), j as (select id, string_agg(token, ' ' order by pos) as terms from f group by 1)
select q.id, coalesce(j.terms, '') as terms from q left join j using (id)""",
    "clean_text": "select doc_id, md5(" + _CLEAN("content") + ") as digest from documents where content is not null",
    "page_text": "select url, md5(" + _CLEAN("translate(coalesce(content, ''), '<>&', '   ')") + ") as digest from documents",
    "page_links": f"""with {_EDGES}, h as (select distinct source_url, regexp_extract(target_url, '^https?://[^/]+(/[^?]*)$', 1) as href from edges)
select source_url, 'https://h' || href as target_url from h where starts_with(href, '/wiki/') and not contains(href, 'disambiguation') and not (""" + " or ".join(f"starts_with(href, '{n}')" for n in NAMESPACES) + ")",
    "osa_pairs": """with recursive q as (select distinct lower(query_text) as q from query_log), w as (select regexp_extract_all(q, '[a-z0-9]+') as t from q),
p as (select distinct t[i] as a, t[i + 1] as b from (select t, unnest(range(1, len(t))) as i from w where len(t) > 1)),
d(a, b, i, two, one) as (select a, b, 0, cast([] as bigint[]), range(0, length(b) + 1) from p union all
  select a, b, i + 1, one, list_transform(range(0, length(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: case when k = 0 then i + 1 else least(
    one[k + 1] + 1, one[k] + case when a[i + 1] = b[k] then 0 else 1 end,
    case when i > 0 and k > 1 and a[i + 1] = b[k - 1] and a[i] = b[k] then two[k - 1] + 1 else 1000 end) end - k))) from d where i < length(a))
select a, b, cast(case when abs(length(a) - length(b)) > 2 then 3 else one[length(b) + 1] end as int) as distance from d where i = length(a)""",
    "insert_if_absent": "select distinct url from pagerank where url is not null and url not in (select url from documents where url is not null)",
    "clean_titles": "select doc_id, " + _TRIM("regexp_replace(title, ' [-–] [A-Z][a-z]+(pedia|atlas|facts|lore|wiki)$', '')") + " as title from documents where title is not null",
}
