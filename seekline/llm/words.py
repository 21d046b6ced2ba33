"""Words and their hashes, shared by the text operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the whole text, in lower case; null gives none."""
    return _WORD.findall(text.lower()) if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 1 << 18):
        self.bound, self.known = bound, {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(hashes) < n:
        return hashes[:0]
    with np.errstate(over="ignore"):
        h = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            h = (h ^ hashes[i : len(hashes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h
