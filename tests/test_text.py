from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekline.config import INDEX_STOP_WORDS, SPELL_STOP_WORDS
from seekline.functions import text as tx
from seekline.functions.edit import osa
from seekline.functions.snippet import make_snippet


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


def test_word_lists():
    assert len(set(INDEX_STOP_WORDS)) == 83 and len(set(SPELL_STOP_WORDS)) == 47
    assert set(SPELL_STOP_WORDS) < set(INDEX_STOP_WORDS)


def test_tokenizers(spark):
    assert one(spark, "The Café's C++17 x-ray, and 2 AI models: A-Z! naïve", tx.tokenize) == ["caf", "17", "ray", "ai", "models", "na", "ve"]
    assert one(spark, "The Café's C++17 x-ray", tx.query_tokens) == ["the", "caf", "s", "c", "17", "x", "ray"]
    assert one(spark, "Kelvin", tx.tokenize) == ["elvin"]
    assert one(spark, "", tx.tokenize) == [] and one(spark, None, tx.tokenize) is None
    assert "".join(one(spark, "Héllo  wörld! a1", tx.spell_tokens)) == "Héllo  wörld! a1"


def test_intent(spark):
    want = {"opposite words": "navigational", "Alan Turing": "navigational", "alan turing": "informational", "decode morse": "technical", "sorting Algorithm": "technical", "history of rome": "informational", "New york": "informational"}
    for q, label in want.items():
        assert one(spark, q, tx.classify_intent) == label


def test_expansion(spark):
    df = spark.createDataFrame([("Big Cat", ["large feline", "BIG"]), ("x", None)], "q string, s array<string>")
    assert [r[0] for r in df.select(tx.expand_terms(F.col("q"), F.col("s"))).collect()] == [["big", "cat", "large", "feline"], ["x"]]
    assert one(spark, 'sure: ["a","b"] ok', tx.parse_synonyms) == ["a", "b"]
    assert one(spark, "none", tx.parse_synonyms) == []


def test_answer(spark):
    got = one(spark, "Yes. It is.\nSources: One. Two!", tx.parse_answer)
    assert (got["answer"], got["sentences"]) == ("Yes. It is.", ["One.", "Two!"])
    got = one(spark, "whole", tx.parse_answer)
    assert (got["answer"], got["sentences"]) == ("whole", [])


def test_presentation(spark):
    assert one(spark, "https://H.org/a//b", tx.breadcrumb) == "h.org › a › b"
    assert one(spark, "not a url", tx.breadcrumb) == "not a url"
    boxes = [([0.0, 9.0, 0.0, 0.0], 5), ([0.0, 8.0, 0.0, 0.0], 7), ([0.0, 2.0, 0.0, 0.0], 10), ([0.0, 0.5, 0.0, 0.0], 12), (None, 8), ([1.0], 8)]
    df = spark.createDataFrame(boxes, "b array<double>, z int")
    assert all(r["y"] == r["z"] for r in df.select("z", tx.zoom(F.col("b")).alias("y")).collect())
    assert one(spark, "a\n\tb   c ", tx.clean_text) == "a b c"
    assert one(spark, "Graph – Wikipedia", tx.clean_title) == "Graph"
    assert one(spark, "a <mark>b</mark>", tx.strip_tags) == "a b"
    assert one(spark, "no_results", tx.reason_message) is None and one(spark, "other", tx.reason_message)


def test_edit_distance():
    for a, b, d in [("ca", "abc", 3), ("abcd", "abdc", 1), ("algoritm", "algorithm", 1), ("teh", "the", 1), ("abdc", "bacd", 2), ("abc", "abcdef", 3)]:
        assert osa(a, b) == d
    assert osa("kitten", "sitting", 9) == 3


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance_properties(a, b):
    assert osa(a, b, 9) == osa(b, a, 9) and (osa(a, b, 9) == 0) == (a == b)


def test_snippets():
    assert make_snippet("Search engines research ranking.", ["search"]) == "<mark>Search</mark> engines re<mark>search</mark> ranking."
    long = "word " * 60 + "alpha beta alpha " + "tail " * 60
    got = make_snippet(long, ["alpha"])
    assert got.count("<mark>") == 2 and got.startswith("...") and got.endswith("...") and len(got) == 233
    assert make_snippet("z" * 250, []) == "z" * 200 + "..."
    assert len(make_snippet("ab " * 100, ["q"])) == 203
    assert make_snippet("", ["a"]) == "" and make_snippet(None, ["a"]) == ""


def test_score_bars(spark):
    got = spark.createDataFrame([((0.5, None, 1.2, 0.126),)], "s struct<bm25:double,vector:double,pagerank:double,final:double>").select(tx.score_bars(F.col("s")).alias("b")).first()["b"]
    assert tuple(got) == (50, 0, 100, 13)
