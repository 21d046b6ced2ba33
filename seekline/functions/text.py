"""Text as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekline.config import INDEX_STOP_WORDS, NAVIGATIONAL_WORDS, TECHNICAL_WORDS

#: Blanks as Unicode has them.
BLANKS = r"(?U)\s+"


def text_or_empty(column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tokenize(text: Column, min_length: int = 2) -> Column:
    """Index terms: runs of ASCII letters and digits, in lower case, without short ones and stop words; order and repeats stay.

    The split comes before the lower case, which could create ASCII letters.
    Null gives null, no term an empty array.
    """
    runs = F.split(text, "[^A-Za-z0-9]+")
    kept = F.filter(runs, lambda x: F.length(x) >= min_length)
    return F.filter(F.transform(kept, F.lower), lambda x: ~x.isin(INDEX_STOP_WORDS))


def is_stop_word(term: Column) -> Column:
    return term.isin(INDEX_STOP_WORDS)


def query_tokens(query: Column) -> Column:
    """Query terms: lower case first, then all runs of a-z and 0-9; stop words and short ones stay."""
    return F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))


def spell_tokens(query: Column) -> Column:
    """Lossless pieces: alphanumeric runs, blank runs, other runs."""
    return F.regexp_extract_all(query, F.lit(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]+"), F.lit(0))


def clean_text(text: Column) -> Column:
    """Line ends and tabs to a blank, runs of blanks to one, outer blanks cut."""
    one = F.regexp_replace(F.regexp_replace(text, r"[\n\t]+", " "), r"(?U)\s{2,}", " ")
    return F.regexp_replace(one, r"(?U)^\s+|\s+$", "")


def clean_title(title: Column, suffix: str = "Wikipedia") -> Column:
    """The title without a trailing `` - suffix`` (hyphen or dash)."""
    return F.regexp_replace(F.regexp_replace(title, rf" [-–] {suffix}$", ""), r"(?U)^\s+|\s+$", "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def parse_answer(text: Column) -> Column:
    """struct(answer, sentences): split at the first ``SOURCES:`` in any case; without one the whole text and no sentences."""
    parts = F.split(text, "(?i)SOURCES:", 2)
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    head, tail = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    sentences = F.filter(F.transform(F.split(tail, r"(?<=[.!?])\s+"), trim), lambda x: x != "")
    return F.struct(trim(head).alias("answer"), sentences.alias("sentences"))


def classify_intent(query: Column) -> Column:
    """navigational, technical or informational, by the first rule that holds; words are looked for as substrings."""
    low = F.lower(query)

    def some(words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    capitals = query.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+")
    return F.when(some(NAVIGATIONAL_WORDS), "navigational").when(capitals, "navigational").when(some(TECHNICAL_WORDS), "technical").otherwise("informational")


def expand_terms(query: Column, synonyms: Column) -> Column:
    """Distinct query tokens followed by those of the synonym phrases."""
    more = F.flatten(F.transform(F.coalesce(synonyms, F.array().cast("array<string>")), query_tokens))
    return F.array_distinct(F.concat(query_tokens(query), more))


def parse_synonyms(reply: Column) -> Column:
    """The strings of the JSON array between the first ``[`` and the last ``]``; anything else gives an empty array."""
    inner = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    parsed = F.from_json(inner, "array<string>")
    return F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def highlight(text: Column, terms: list[str], min_length: int = 1) -> Column:
    """Marks every occurrence of a term, in any case, also inside words; terms shorter than ``min_length`` are left out."""
    import re

    kept = list(dict.fromkeys(t.lower() for t in terms if len(t) >= min_length and t))
    if not kept:
        return text
    return F.regexp_replace(text, "(?iu)(" + "|".join(re.escape(t) for t in kept) + ")", "<mark>$1</mark>")


def breadcrumb(url: Column) -> Column:
    """Host and path parts joined by ``›``; a url that can't be read stays as it is."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    return F.when(host.isNull(), url).otherwise(F.array_join(F.concat(F.array(F.lower(host)), parts), " › "))


def zoom(box: Column) -> Column:
    """Map zoom from a bounding box's latitudes; 8 where there is none."""
    span = F.abs(box[1] - box[0])
    return F.when(F.coalesce(F.size(box), F.lit(-1)) < 4, 8).when(span > 8, 5).when(span > 2, 7).when(span > 0.5, 10).otherwise(12)


def bold_prefix(title: Column, prefix: Column) -> Column:
    """struct(head, tail): a suggestion cut behind the typed prefix."""
    n = F.length(prefix)
    return F.struct(title.substr(F.lit(1), n).alias("head"), title.substr(n + 1, F.length(title)).alias("tail"))


def score_bars(scores: Column, names: tuple[str, ...] = ("bm25", "vector", "pagerank", "final")) -> Column:
    """A struct of scores in 0..1 as whole percent, the lengths of their bars; a missing score has none."""
    return F.struct(*[F.round(F.least(F.greatest(F.coalesce(scores[n], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100).cast("int").alias(n) for n in names])


def reason_message(reason: Column) -> Column:
    """A short note why there is no summary; null where none was to be expected (navigational queries, no results)."""
    quiet = reason.isin("skipped_navigational", "no_results")
    return F.when(reason.isNotNull() & ~quiet, F.concat(F.lit("no summary: "), F.translate(reason, "_", " ")))
