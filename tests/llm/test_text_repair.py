import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekline.llm import boilerplate, mojibake, packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 60))
def test_best_fit(sizes, capacity):
    got = packing.best_fit_decreasing(np.array(sizes, int), capacity)
    # The same by looking at every open container.
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            b = room.index(min(fits))
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[i]
        want[i] = b
    fill = np.bincount(got, weights=sizes) if sizes else np.zeros(0)
    assert (fill <= capacity).all()
    assert sorted(fill.astype(int)) == sorted(capacity - r for r in room)


def test_segment_tree():
    t = packing.SegmentTree(10)
    assert t.tightest(1) == -1
    t.add(4, 1)
    t.add(9, 2)
    assert (t.tightest(1), t.tightest(4), t.tightest(5), t.tightest(10)) == (4, 4, 9, -1)
    t.add(9, -2)
    assert t.tightest(5) == -1


def test_pack(spark):
    sizes = spark.createDataFrame([(1, 7), (2, 3), (3, 25), (4, 0), (5, None), (6, 5), (None, 3)], "doc_id long, tokens int").withColumn("capacity", F.lit("clash"))
    budgets = spark.createDataFrame([(1, 10), (2, 100), (3, None), (4, 0), (1, 10)], "budget_id long, capacity int")
    got = packing.pack(sizes, budgets).collect()
    one = [r for r in got if r["budget_id"] == 1]
    assert {(r["doc_id"], r["piece"], r["start"], r["tokens"]) for r in one} == {(1, 0, 0, 7), (2, 0, 0, 3), (3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 5), (6, 0, 0, 5)}
    assert len({r["container"] for r in one}) == 4 and {r["budget_id"] for r in got} == {1, 2}
    fill = {r["budget_id"]: r for r in packing.fill_report(packing.pack(sizes, budgets)).collect()}
    assert fill[1]["containers"] == 4 and fill[1]["tokens"] == 40 and fill[2]["containers"] == 1
    right = {r["budget_id"]: r for r in packing.packing_check(sizes, packing.pack(sizes, budgets)).collect()}
    assert right[1]["texts"] == 4 and all(right[b][c] == 0 for b in (1, 2) for c in ("lost", "repeated", "split", "overfull"))
    broken = packing.pack(sizes, budgets).where("doc_id <> 2").withColumn("tokens", F.when(F.col("doc_id") == 6, 11).otherwise(F.col("tokens")))
    wrong = {r["budget_id"]: r for r in packing.packing_check(sizes, broken).collect()}
    assert wrong[1]["lost"] == 2 and wrong[1]["overfull"] == 1
    assert packing.pack(sizes.limit(0), budgets).count() == 0 and packing.pack(sizes, budgets.limit(0)).count() == 0


def test_blocks(spark):
    sizes = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 30 + 1).cast("int").alias("tokens"))
    budgets = spark.createDataFrame([(1, 64)], "budget_id long, capacity int")
    got = packing.pack(sizes, budgets, block=100)
    assert got.count() == 500 and got.select("block").distinct().count() == 5
    assert packing.fill_report(got).first()["fill"] > 0.95


def test_token_sizes(spark):
    long = "word " * 40_000
    df = spark.createDataFrame([(1, "Hello world, it's"), (2, None), (3, ""), (4, long), (5, "é" * 60_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(df).collect()}
    assert got[1] == 5 and got[2] == got[3] == 0 and got[4] == len(packing._encoding(packing.DEFAULT_VOCABULARY).encode_ordinary(long)) and got[5] >= 30_000


SENTENCES = ["Der Fluss erklärt die Brücke für große Räume.", "La rivière précède la forêt et répète le modèle.", "El año reemplaza la montaña y midió la población."]


@pytest.fixture()
def mixed(spark):
    rows = [(i, SENTENCES[i % 3] + f" Nr {i}", f"s{i % 4}" if i % 7 else None) for i in range(300)]
    whole = lambda t, enc: t.encode("utf-8").decode(enc)
    rows[10] = (10, whole(rows[10][1], "cp1252"), "s1")
    rows[11] = (11, whole(rows[11][1], "latin-1"), "s1")
    rows[12] = (12, whole(whole(rows[12][1], "cp1252"), "cp1252"), None)
    rows[13] = (13, rows[13][1].encode("cp1252").decode("cp1251"), "s2")
    rows[14] = (14, rows[14][1].replace("midió", "midiÃ³"), "s2")
    rows[15] = (15, rows[15][1].replace("ä", "�"), "s2")
    rows += [(1000, None, "s1"), (1001, "", "s1"), (1002, "plain ascii", "s1"), (1003, "Ã" * 5000, "s1"), (10, rows[10][1], "s1")] + [(2000 + i, "The letters Ã, Â and Ð; «Ã» 5 ¢", "s3") for i in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("chain", F.lit("clash")).withColumn("field", F.lit("clash"))


def test_garbled(mixed):
    got = {r["doc_id"] for r in mojibake.garbled_records(mixed).collect()}
    assert got == {10, 11, 12, 13, 14, 15}
    assert mojibake.garbled_records(mixed.limit(0)).count() == 0
    assert mojibake.garbled_records(mixed.where("doc_id = 1002")).count() == 0


def test_restored(mixed):
    got = {r["doc_id"]: r["restored"] for r in mojibake.restored_texts(mixed).collect()}
    for i in (10, 11, 12, 13, 14):
        assert got[i] == SENTENCES[i % 3] + f" Nr {i}"
    assert "�" in got[15]


@settings(max_examples=200, deadline=None)
@given(st.text("abcéèüñß’—", min_size=1, max_size=12), st.sampled_from([c for c in mojibake.CHAINS if c[0].startswith("utf8_") and len(c[1]) == 1]))
def test_round_trip(word, chain):
    name, (pair,) = chain
    table = mojibake._high_half(pair[1])
    raw = word.encode("utf-8")
    if all(b < 0x80 or b in table for b in raw) and len(set(table.values())) == len(table):
        harmed = "".join(chr(b) if b < 0x80 else table[b] for b in raw)
        assert mojibake.undo(harmed, (pair,)) == (word if harmed != word else None)


def page(rng, i):
    article = [" ".join("w" + chr(97 + k % 20) + chr(97 + k // 20) for k in rng.integers(0, 400, 14)) + "." for _ in range(3)]
    lines = ["Home", "News", "Forum", "Contact", "", article[0], f"Heading{"abcdefghij"[i % 10]}", article[1], f"You may also like Page{'abcdefghij'[rng.integers(0, 10)]}{'klmnopqrst'[rng.integers(0, 10)]} tower", article[2]]
    lines += [f"Views: {rng.integers(1, 9999)} · Shares: {rng.integers(1, 99)}", "Back to the top of page", "© 2021 Examplewiki. All rights reserved."]
    return "\n".join(lines)


@pytest.fixture()
def pages(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"https://{'en' if i % 2 else 'de'}.examplewiki.org/p{i}", page(rng, i)) for i in range(120)]
    rows += [(900, "https://lone.org/x", page(rng, 1).replace("Examplewiki", "Lone")), (901, None, "Only text here, nothing more.\nAnd more."), (902, "u", None), (903, "u", ""), (904, "https://x.org", "\n\n"), (None, "https://x.org", "x")]
    return spark.createDataFrame(rows, "doc_id long, url string, content string").withColumn("host", F.lit("clash")).withColumn("line_no", F.lit(0))


def test_template(pages):
    got: dict = {}
    for r in boilerplate.template_lines(pages).collect():
        got.setdefault(r["doc_id"], set()).add(r["line_no"])
    want = {1, 2, 3, 4, 9, 11, 12, 13}
    assert sum(got.get(i) == want for i in range(120)) >= 118, [got.get(i) for i in range(6)]
    assert got[900] == want and not {901, 902, 903, 904} & set(got)
    assert boilerplate.template_lines(pages.limit(0)).count() == 0


def test_main(pages):
    got = {r["doc_id"]: r["main"] for r in boilerplate.main_content(pages.where("doc_id is not null")).collect()}
    assert "Forum" not in got[5] and "Headingf" in got[5] and got[902] is None and got[903] == "" and got[901].startswith("Only")


def test_large_template_is_joined(pages, monkeypatch):
    want = {tuple(r) for r in boilerplate.template_lines(pages).collect()}
    monkeypatch.setattr(boilerplate, "MAX_SENT", 3)
    got = {tuple(r) for r in boilerplate.template_lines(pages).collect()}
    assert got == want


def test_classes_of_a_host(spark):
    rng = np.random.default_rng(8)
    # A menu of three, a label with a slot and a counter stand on every page; a heading of one word and sentences stand on some.
    rows = [(i, "https://www.somewiki.org/p", "\n".join(["Start", "Topics", "People", *(["History"] if i % 2 else []), words_of(rng, 12) + ".", f"See other pages {words_of(rng, 2)}", f"Seen {i} times today", "Kept for you."])) for i in range(20)]
    got = boilerplate.equivalence_classes(pages_of(spark, rows))
    names = {"Start", "Topics", "People", "See other pages", "Seen # times today"}
    tokens = {r["token"] for r in got.collect()}
    assert {boilerplate._hash("P", f" {n}") for n in names} <= tokens and boilerplate._hash("P", " History") not in tokens and boilerplate._hash("P", " Kept for you.") not in tokens
    # A line twice on a page is another vector than a line once on it.
    twice = [(i, "https://h.org", "One\nOne\nTwo\nThree") for i in range(6)]
    assert {r["token"] for r in boilerplate.equivalence_classes(pages_of(spark, twice)).collect()} == set()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, url string, content string").mapInArrow(boilerplate._read_lines, boilerplate.PAGES)


def words_of(rng, n):
    return " ".join("w" + chr(97 + k % 20) + chr(97 + k // 20) for k in rng.integers(0, 400, n))


def test_notice_of_a_small_host_in_a_large_table(spark):
    rng = np.random.default_rng(5)
    menu, foot = ["Start", "Topics", "People", "Places"], "Smallfacts keeps cookies to know you again."
    # Eight pages with a notice, four copies of one article whose first line follows the menu, and many pages of others.
    rows = [(i, "https://www.smallfacts.org/p", "\n".join([*menu, *[words_of(rng, 12) + "." for _ in range(3)], foot])) for i in range(8)]
    copied = [words_of(rng, 14) + "." for _ in range(3)]
    rows += [(10 + i, f"https://www.smallfacts.org/c{i}", "\n".join([*menu, *copied, foot])) for i in range(4)]
    rows += [(20, "https://www.smallfacts.org/n", "\n".join([*menu, *[words_of(rng, 12) + "." for _ in range(3)]]))]
    rows += [(100 + i, f"https://big.org/{i}", "\n".join(words_of(rng, 12) + "." for _ in range(3))) for i in range(14_000)]
    got: dict = {}
    for r in boilerplate.template_lines(spark.createDataFrame(rows, "doc_id long, url string, content string")).collect():
        got.setdefault(r["doc_id"], set()).add(r["line_no"])
    assert all(got[i] == {1, 2, 3, 4, 8} for i in [*range(8), *range(10, 14)]), got


def test_bound_of_sent_tokens_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    links = ["Maps", "Tools", "Help", "Shop", "Jobs", "Press"]
    rows = []
    for i in range(60):
        lines = page(rng, i).split("\n")
        row = " | ".join(links[k] for k in rng.permutation(6)[: 3 + i % 3])
        rows.append((i, f"https://{'en' if i % 2 else 'de'}.examplewiki.org/p{i}", "\n".join([*lines[:4], f"Part{'abc'[i % 3]}", *lines[4:7], row, *lines[7:]])))
    docs = spark.createDataFrame(rows, "doc_id long, url string, content string")
    want = {tuple(r) for r in boilerplate.template_lines(docs).collect()}
    assert {(i, 9) for i in range(60)} <= want
    monkeypatch.setattr(boilerplate, "MAX_SENT", 0)
    assert {tuple(r) for r in boilerplate.template_lines(docs).collect()} == want


def test_line_once_on_each_of_many_hosts(spark):
    rng = np.random.default_rng(4)
    menu, foot = ["Start", "Topics", "People", "Places"], "Sitemap"
    rows = [(i, "https://www.large.org/p", "\n".join([*menu, *[words_of(rng, 12) + "." for _ in range(3)]])) for i in range(6)]
    rows += [(100 + i, f"https://h{i}x.org/", "\n".join([*menu, *[words_of(rng, 12) + "." for _ in range(3)], foot, "Imprint"])) for i in range(30)]
    got = {tuple(r) for r in boilerplate.template_lines(spark.createDataFrame(rows, "doc_id long, url string, content string")).collect()}
    assert {(100 + i, 9) for i in range(30)} <= got and not any(line in (5, 6, 7) for _, line in got)
