"""Pages to text and links."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from seekline.config import DROPPED_CLASSES, DROPPED_IDS, DROPPED_TAGS, NAMESPACES
from seekline.functions.text import clean_text, clean_title

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects the title, the text of one container without dropped parts, and the anchors."""

    def __init__(self, container: tuple[str, str] | None):
        super().__init__(convert_charrefs=True)
        self.container, self.title, self.text, self.links = container, [], [], []
        self.open: list[tuple[str, bool, bool]] = []  # tag, inside the container, dropped

    def _state(self):
        return self.open[-1][1:] if self.open else (self.container is None, False)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        inside, dropped = self._state()
        if self.container and (a.get("id") == self.container[1] if self.container[0] == "id" else tag == self.container[1]):
            inside = True
        if tag in DROPPED_TAGS or a.get("id") in DROPPED_IDS or set((a.get("class") or "").split()) & set(DROPPED_CLASSES):
            dropped = True
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], a.get("lang")))
        if tag not in _VOID:
            self.open.append((tag, inside, dropped))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        inside, dropped = self._state()
        if any(t == "title" for t, *_ in self.open):
            self.title.append(data)
        elif inside and not dropped:
            self.text.append(data)


def parse_page(html: str | None, container: tuple[str, str] | None = ("id", "bodyContent")) -> dict:
    """Raw title, text and (href, lang) of the anchors in order; no page gives nulls."""
    if not html:
        return {"title": None, "text": None, "links": []}
    p = _Page(container)
    p.feed(html)
    p.close()
    return {"title": "".join(p.title), "text": "".join(p.text), "links": p.links}


def pages(raw: DataFrame, container: tuple[str, str] | None = ("id", "bodyContent"), suffix: str = "Wikipedia") -> DataFrame:
    """``url, title, text, anchors`` from (url, html); cleaned as for the index; a page that failed to load has nulls."""

    @pandas_udf("title string, text string, anchors array<struct<href:string,lang:string>>")
    def parse(html: pd.Series) -> pd.DataFrame:
        got = [parse_page(h, container) for h in html]
        return pd.DataFrame({"title": [g["title"] for g in got], "text": [g["text"] for g in got], "anchors": [[{"href": h, "lang": x} for h, x in g["links"]] for g in got]})

    out = raw.withColumn("p", parse("html"))
    return out.select("url", clean_title(F.col("p.title"), suffix).alias("title"), clean_text(F.col("p.text")).alias("text"), F.col("p.anchors").alias("anchors"))


def page_links(parsed: DataFrame, base: str, prefix: str = "/wiki/", namespaces: list[str] = NAMESPACES) -> DataFrame:
    """``source_url, target_url`` in page order, each target once a page.

    Anchors of another language than English, outside ``prefix``, in a
    namespace or on a disambiguation page are left out; fragments and
    self-links are kept.
    """
    href = lambda a: a["href"]
    fits = lambda a: (a["lang"].isNull() | (a["lang"] == "") | (a["lang"] == "en")) & F.startswith(href(a), F.lit(prefix)) & ~F.contains(href(a), F.lit("disambiguation"))

    def article(a):
        out = fits(a)
        for n in namespaces:
            out = out & ~F.startswith(href(a), F.lit(n))
        return out

    kept = F.filter("anchors", article)
    urls = F.array_distinct(F.transform(kept, lambda a: F.concat(F.lit(base), href(a))))
    return parsed.select(F.col("url").alias("source_url"), F.explode(urls).alias("target_url"))


def http_fetcher(agent: str = "seekline", seconds: float = 10.0) -> Callable[[str], str | None]:
    """A fetcher over HTTP with a user agent and a time limit."""

    def get(url: str) -> str | None:
        import urllib.request

        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=seconds) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    return get


def fetch(frontier: DataFrame, fetcher: Callable[[str], str | None], seconds: float = 10.0, together: int = 3) -> DataFrame:
    """``url, html`` by a function from url to page text, ``together`` pages at a time in each task.

    A page that fails or takes longer than ``seconds`` is null and stops nothing.
    """

    def run(batches):
        for batch in batches:
            pool = ThreadPoolExecutor(together)
            asked = [pool.submit(fetcher, url) for url in batch["url"]]
            out = []
            for one in asked:
                try:
                    out.append(one.result(timeout=seconds))
                except Exception:
                    one.cancel()
                    out.append(None)
            pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame({"url": batch["url"], "html": pd.Series(out, dtype="object")})

    return frontier.select("url").mapInPandas(run, "url string, html string")


def new_documents(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages with a title and a text whose url isn't stored yet: what a crawl step saves and announces."""
    good = parsed.where("length(title) > 0 and length(text) > 0").dropDuplicates(["url"])
    return good.join(stored.select("url"), "url", "left_anti").select("url", "title", "text")
