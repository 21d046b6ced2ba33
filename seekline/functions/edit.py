"""Edit distance with adjacent transpositions (optimal string alignment)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def osa(a: str, b: str, limit: int = 2) -> int:
    """Distance of ``a`` and ``b``, no substring edited twice; ``limit + 1`` at once where the lengths differ by more than ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def _distances(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


@functools.cache
def osa_udf():
    """The Arrow function behind ``osa_distance``, made on first use on the driver."""
    return pandas_udf(_distances, IntegerType())


def osa_distance(a, b):
    return osa_udf()(a, b)
