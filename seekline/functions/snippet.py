"""Snippets: the densest window of a text, cut at blanks, with its terms marked."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

WINDOW = 200


def make_snippet(content: str | None, terms, window: int = WINDOW) -> str:
    """The window of ``window`` characters with most term hits (the first of equals), widened to whole words.

    Terms match in any case and inside words.  No content gives an empty text;
    no term, or no hit, the beginning of the content.
    """
    if not content:
        return ""
    wanted = list(dict.fromkeys(t.lower() for t in (terms if terms is not None else []) if t))
    if not wanted:
        return content[:window] + ("..." if len(content) > window else "")
    pattern = re.compile("(" + "|".join(map(re.escape, wanted)) + ")", re.IGNORECASE)
    hits = [m.start() for m in pattern.finditer(content)]
    start, most = 0, 0
    for h in hits:
        s = max(0, h - window // 2)
        n = bisect_left(hits, s + window) - bisect_left(hits, s)
        if n > most:
            start, most = s, n
    end = min(len(content), start + window)
    while start > 0 and not content[start - 1].isspace():
        start -= 1
    while end < len(content) and not content[end].isspace():
        end += 1
    marked = pattern.sub(r"<mark>\1</mark>", content[start:end].strip())
    return ("..." if start > 0 else "") + marked + ("..." if end < len(content) else "")


def _snippets(content: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([make_snippet(c, t) for c, t in zip(content, terms)], dtype="object")


@functools.cache
def snippet_udf():
    """The Arrow function behind ``snippet``, made on first use on the driver."""
    return pandas_udf(_snippets, StringType())


def snippet(content, terms):
    return snippet_udf()(content, terms)
