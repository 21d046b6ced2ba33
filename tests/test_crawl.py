from seekline.plans.crawl import crawl


def page(title, *hrefs):
    return f"<title>{title} - Wikipedia</title><div id=bodyContent>text of {title}" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</div>"


PAGES = {"https://h/wiki/A": page("A", "/wiki/B", "/wiki/C", "/wiki/A"), "https://h/wiki/B": page("B", "/wiki/A", "/wiki/D"), "https://h/wiki/C": page(""), "https://h/wiki/D": None}


def test_crawl(spark):
    roots = spark.createDataFrame([("https://h/wiki/A",), ("https://h/wiki/A",), (None,)], "url string")
    got = crawl(roots, PAGES.__getitem__, "https://h")
    assert {(r["url"][-1], r["level"]) for r in got.visited.collect()} == {("A", 0), ("B", 1), ("C", 1), ("D", 2)}
    assert {r["title"] for r in got.documents.collect()} == {"A", "B"}
    assert {(r["source_url"][-1], r["target_url"][-1]) for r in got.links.collect()} == {("A", "B"), ("A", "C"), ("A", "A"), ("B", "A"), ("B", "D")}
    assert crawl(roots, PAGES.__getitem__, "https://h", limit=2).visited.count() == 2
    assert crawl(roots, PAGES.__getitem__, "https://h", stored=got.documents).documents.count() == 0
