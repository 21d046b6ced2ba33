"""A crawl as level-synchronous steps over DataFrames."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.config import DEFAULTS
from seekline.operators import graph, html
from seekline.plans.lineage import materialize
from seekline.sources.tables import partitions


class Crawl(NamedTuple):
    documents: DataFrame
    links: DataFrame
    visited: DataFrame


def crawl(
    roots: DataFrame,
    fetcher: Callable[[str], str | None],
    base: str,
    stored: DataFrame | None = None,
    container: tuple[str, str] | None = ("id", "bodyContent"),
    limit: int = DEFAULTS.crawl_limit,
) -> Crawl:
    """Fetch ``roots`` (url) and what they lead to, until no page is new or ``limit`` pages were visited.

    Gives the new documents (url, title, text), all distinct edges, also those
    of pages that weren't saved, and the visited urls with their level.  A page
    that fails to load is visited but saves nothing and stops nothing.  Within
    a level pages are taken in the order of their urls, so the cap is the same
    in every run; ``stored`` documents are not saved again.
    """
    front = materialize(roots.select("url").where("url is not null").distinct().orderBy("url").limit(limit).withColumn("level", F.lit(0)), "front")
    visited, total, width = front, front.count(), max(partitions(front.sparkSession), front.sparkSession.sparkContext.defaultParallelism)
    documents = links = None
    for level in itertools.count(1):
        # A level that was cut to the cap lies in one partition; its pages are fetched by all tasks.
        parsed = materialize(html.pages(html.fetch(front.repartition(width), fetcher), container), "pages")
        saved = parsed.select("url", "title", "text")
        fresh = html.new_documents(saved, stored if stored is not None else saved.limit(0))
        edges = html.page_links(parsed, base)
        documents = fresh if documents is None else documents.unionByName(fresh)
        links = edges if links is None else links.unionByName(edges)
        if total >= limit:
            break
        front = materialize(graph.unvisited(edges, visited).orderBy("url").limit(limit - total).withColumn("level", F.lit(level)), "front")
        n = front.count()
        if not n:
            break
        total += n
        visited = visited.unionByName(front)
        if level % 16 == 0:  # a deep crawl doesn't grow the plan
            visited, documents, links = (materialize(x, "crawled") for x in (visited, documents, links))
    return Crawl(documents.dropDuplicates(["url"]), links.distinct(), visited)
