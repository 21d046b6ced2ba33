"""Spelling correction against the index's dictionary."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekline.config import DEFAULTS, INDEX_STOP_WORDS, SPELL_STOP_WORDS, Settings
from seekline.functions.edit import osa_distance
from seekline.functions.text import spell_tokens
from seekline.plans.lineage import materialize
from seekline.sources.tables import spread


def _without(word: Column, at: Column) -> Column:
    return F.concat(word.substr(F.lit(1), at - 1), word.substr(at + 1, F.length(word)))


def _places(word: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))


def _deletions(word: Column, distance: int) -> Column:
    """The word and everything left of it after dropping up to ``distance`` characters."""
    out = F.array(word)
    for _ in range(distance):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda w: F.transform(_places(w), lambda i: _without(w, i))))))
    return out


def _one_less(rows: DataFrame, column: str, at: str) -> DataFrame:
    """Rows by ``form``: the word itself with 0 as ``at``, and without each of its characters with that one's place."""
    word = F.col(column)
    less = F.transform(_places(word), lambda i: F.struct(_without(word, i).alias("form"), i.alias(at)))
    whole = F.array(F.struct(word.alias("form"), F.lit(0).alias(at)))
    return rows.select(*rows.columns, F.inline(F.concat(whole, less)))


def _rank(*first: Column) -> Column:
    return F.struct(*first, (-F.col("freq")).alias("less"), F.length("term").alias("len"), "term", "freq")


#: Most bytes of all words' forms that are sent to every task.
FORM_BYTES = 16_000_000


def best_corrections(words: DataFrame, dictionary: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """``word, correction, distance, freq`` for words that are to be replaced.

    Two words within distance 2 share a form left after dropping at most two
    characters of either, so candidates are found by an equi-join on these
    forms instead of comparing every word with every term of like length.  The
    best has the least distance, then the highest frequency, then the least
    length and the smaller term.  A word that is itself in the dictionary is
    replaced only by a best at least ``spell_dominance`` times as frequent.

    A farther term can't be the best of a word with one at distance 1, so the
    few forms without one character come first, and the many without two are
    made only for words that have found nothing.

    Spark takes exploded rows for as small as the words they come from, and
    would broadcast millions of forms.  So the joins are named: the forms of
    words up to ``FORM_BYTES`` are broadcast, all others are joined by sort.
    Jobs run when this is called: the distinct words, a figure of their lengths,
    and their state after the first step.
    """
    words = spread(materialize(words.select("word").where("word is not null").distinct(), "words"))
    # Only terms of a length that some word can reach take part.
    lengths = words.select(F.explode(F.sequence(F.length("word") - s.spell_distance, F.length("word") + s.spell_distance)).alias("len")).distinct()
    terms = spread(dictionary.select("term", "freq")).withColumn("len", F.length("term")).join(F.broadcast(lengths), "len", "left_semi").select("term", "freq")
    n = F.length("word").cast("double")
    how = "broadcast" if (words.agg(F.sum(n * n / 2 * (n + 40))).first()[0] or 0) <= FORM_BYTES else "merge"
    # Of one form, equal places are a replaced character, neighbouring ones an exchange if the dropped characters are equal, and the form itself an added or a lost one.
    crossed = (F.abs(F.col("i") - F.col("j")) == 1) & (F.col("word").substr(F.col("i"), F.lit(1)) == F.col("term").substr(F.col("j"), F.lit(1)))
    near = _one_less(words, "word", "i").hint(how).join(_one_less(terms, "term", "j"), "form").where((F.col("i") == F.col("j")) | (F.col("i") == 0) | (F.col("j") == 0) | crossed)
    other = F.col("word") != F.col("term")
    found = near.groupBy("word").agg(F.max(F.when(~other, F.col("freq"))).alias("own"), F.min(F.when(other, _rank(F.lit(1).alias("distance")))).alias("best"))
    first = materialize(words.join(found, "word", "left"), "corrections")
    steps = [first]
    if s.spell_distance > 1:
        # Forms by hash: every pair is checked.
        forms = lambda df, column: df.withColumn("form", F.explode(_deletions(F.col(column), s.spell_distance))).withColumn("form", F.xxhash64("form"))
        pairs = forms(spread(first.where("best is null").select("word", "own")), "word").hint(how).join(forms(terms, "term"), "form").where(other)
        # None is at distance 1 here, so 2 edits without exchanges are the distance.  An alignment with exchanges has at most twice as many without, which the JVM counts; few pairs are left for Python.
        pairs = pairs.withColumn("plain", F.levenshtein("word", "term", 2 * s.spell_distance)).where("plain >= 0")
        unsure = lambda c: F.when(F.col("plain") > 2, F.col(c))
        pairs = pairs.withColumn("distance", F.coalesce(osa_distance(unsure("word"), unsure("term")), "plain"))
        steps.append(pairs.groupBy("word").agg(F.max("own").alias("own"), F.min(F.when(F.col("distance") <= s.spell_distance, _rank(F.col("distance")))).alias("best")))
    out = functools.reduce(DataFrame.unionByName, [x.select("word", "own", "best.distance", "best.freq", F.col("best.term").alias("correction")) for x in steps])
    kept = out.where(F.col("correction").isNotNull() & (F.col("own").isNull() | (F.col("freq") >= s.spell_dominance * F.col("own"))))
    return kept.select("word", "correction", "distance", "freq")


def correct(queries: DataFrame, dictionary: DataFrame, protect_index_stopwords: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """``query_id, original, corrected, was_changed``.

    Only purely alphabetic pieces of at least four letters that are no stop
    words are looked up; a replacement is in lower case, all else stays as it
    was, blanks included.  Only these words leave their query, once each.
    """
    stop = INDEX_STOP_WORDS + SPELL_STOP_WORDS if protect_index_stopwords else SPELL_STOP_WORDS
    wanted = lambda p: p.rlike("^[A-Za-z]+$") & (F.length(p) >= s.spell_min_length) & ~F.lower(p).isin(stop)
    pieces = spell_tokens(F.col("query_text"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(F.filter(pieces, wanted), F.lower))).alias("word"))
    fixes = best_corrections(asked.select("word"), dictionary, s).select("word", "correction")
    found = asked.join(fixes.hint("merge"), "word").groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("fixes"))
    text = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.when(wanted(p), F.element_at("fixes", F.lower(p))), p)), "")
    out = queries.select("query_id", "query_text").join(found, "query_id", "left")
    out = out.select("query_id", F.col("query_text").alias("original"), F.when(F.col("fixes").isNull(), F.col("query_text")).otherwise(text).alias("corrected"))
    return out.withColumn("was_changed", F.coalesce(F.col("corrected") != F.col("original"), F.lit(False)))
