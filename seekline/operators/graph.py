"""Link graph: edges, PageRank, breadth-first crawl order."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, Settings
from seekline.plans.lineage import laid_out, materialize, release
from seekline.sources.tables import partitions


def edges(links: DataFrame) -> DataFrame:
    """Distinct edges (source_url, target_url); null or blank ends are dropped, self-loops and fragments kept."""
    return links.select("source_url", "target_url").where("trim(source_url) <> '' and trim(target_url) <> ''").distinct()


def nodes(links: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Sources, targets and document urls, each once."""
    e = links.select(F.explode(F.array("source_url", "target_url")).alias("url"))
    if docs is not None:
        e = e.unionByName(docs.select("url"))
    return e.where("url is not null").distinct()


def out_degrees(links: DataFrame) -> DataFrame:
    return links.groupBy("source_url").agg(F.count(F.lit(1)).alias("out_degree"))


def dangling(all_nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return all_nodes.join(links.select(F.col("source_url").alias("url")), "url", "left_anti")


#: Edges of one source that are kept together; a page with more is split.
HUB = 1 << 16


def pagerank(links: DataFrame, docs: DataFrame | None = None, s: Settings = DEFAULTS, fixed_rounds: int | None = None) -> tuple[DataFrame, int]:
    """``url, score`` and the number of rounds.

    Synchronous updates from 1/N; the rank of dangling nodes is spread evenly;
    it stops once the ranks move by less than ``epsilon`` in sum, or after
    ``max_iterations``.  Urls are numbered once.  The edges are laid out once,
    in buckets by (source, salt), a source of more than ``HUB`` edges having
    several salts; a round moves only the ranks to them and the contributions,
    added up before, back, so neither a page with a third of all links nor one
    that a third of all links name is a single task's.
    """
    spark = links.sparkSession
    parts = partitions(spark)
    e = materialize(edges(links), "edges")
    named = materialize(nodes(e, docs).withColumn("id", F.monotonically_increasing_id()), "nodes")
    n = named.count()
    if n == 0:
        return spark.createDataFrame([], "url string, score double"), 0
    degree = materialize(out_degrees(e).join(named.select(F.col("url").alias("source_url"), F.col("id").alias("src")), "source_url").select("src", "out_degree"), "degrees")
    numbered = e.join(named.select(F.col("url").alias("source_url"), F.col("id").alias("src")), "source_url").join(named.select(F.col("url").alias("target_url"), F.col("id").alias("dst")), "target_url").select("src", "dst")
    salts = F.ceil(F.col("out_degree") / F.lit(HUB)).cast("int")
    hubs = degree.where(F.col("out_degree") > HUB).select("src", salts.alias("salts"))
    linking = degree.agg(F.count(F.lit(1)).alias("n"), F.max("out_degree").alias("most")).first()
    keys = ["src", "salt"] if (linking["most"] or 0) > HUB else ["src"]
    if len(keys) > 1:
        numbered = numbered.join(hubs, "src", "left").select("src", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), F.col("salts"))).cast("int").alias("salt"), "dst")
    graph = laid_out(numbered, keys, parts, "edges")
    ranks = named.select("id").join(degree.withColumnRenamed("src", "id"), "id", "left").withColumn("rank", F.lit(1.0 / n))
    loose, held, written, done = (n - linking["n"]) / n, [], [], 0
    for i in range(fixed_rounds if fixed_rounds is not None else s.max_iterations):
        share = ranks.where("out_degree is not null").select(F.col("id").alias("src"), *([F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")] if len(keys) > 1 else []), (F.col("rank") / F.col("out_degree")).alias("share"))
        given = graph.join(share, keys).groupBy("dst").agg(F.sum("share").alias("given"))
        fresh = ranks.join(given.withColumnRenamed("dst", "id"), "id", "left").select("id", "out_degree", (F.lit((1 - s.damping) / n + s.damping * loose / n) + s.damping * F.coalesce("given", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        # Kept for the next round; every few rounds the lineage is cut, and what was kept before is let go.
        cut = (i + 1) % 5 == 0
        fresh = materialize(fresh, "ranks") if cut else fresh.persist()
        seen = fresh.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved"), F.coalesce(F.sum(F.when(F.col("out_degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")).first()
        if cut:
            while held:
                held.pop().unpersist()
            release(*written)
            written = [fresh]
        else:
            held.append(fresh)
        ranks, loose, done = fresh.select("id", "out_degree", "rank"), seen["loose"], i + 1
        if fixed_rounds is None and seen["moved"] < s.epsilon:
            break
    ranks = materialize(ranks, "ranks")
    while held:
        held.pop().unpersist()
    release(e, graph, *written)
    return named.join(ranks, "id").select("url", F.col("rank").alias("score")), done


def persist_scores(scores: DataFrame) -> DataFrame:
    """The pagerank table: ``url, score, updated_at``."""
    return scores.select("url", "score", F.current_timestamp().alias("updated_at"))


def upsert_scores(stored: DataFrame, scores: DataFrame) -> DataFrame:
    """The pagerank table after a run: a scored url's row is replaced, other rows stay as they were."""
    return stored.select("url", "score", "updated_at").join(scores.select("url").distinct(), "url", "left_anti").unionByName(persist_scores(scores))


def latest_scores(stored: DataFrame) -> DataFrame:
    """One score a url of a table with older and newer rows: the newest, on equal times the largest."""
    return stored.where("url is not null and score is not null").groupBy("url").agg(F.max_by("score", F.struct(F.coalesce("updated_at", F.timestamp_seconds(F.lit(0))), "score")).alias("score"))


def unvisited(found: DataFrame, visited: DataFrame) -> DataFrame:
    """Link targets nobody has visited, each once."""
    return found.select(F.col("target_url").alias("url")).where("url is not null").distinct().join(visited.select("url"), "url", "left_anti")


def bfs(links: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """``url, level``: pages reachable from the roots, level by level until a level is empty, however deep.

    ``limit`` caps the number of pages as a crawl does; within a level pages
    are taken in the order of their urls.
    """
    e = materialize(edges(links), "edges")
    seen = front = materialize(roots.select("url").distinct().withColumn("level", F.lit(0)), "front")
    total = seen.count()
    for level in itertools.count(1):
        if limit is not None and total >= limit:
            break
        step = e.join(front.select(F.col("url").alias("source_url")), "source_url", "left_semi")
        fresh = unvisited(step, seen).withColumn("level", F.lit(level))
        if limit is not None:
            fresh = fresh.orderBy("url").limit(limit - total)
        front = materialize(fresh, "front")
        n = front.count()
        if not n:
            break
        total += n
        seen = seen.unionByName(front)  # each level's pages stay where they were written
        if level % 16 == 0:
            seen = materialize(seen, "seen")  # a deep graph doesn't grow the plan
    return seen
