"""Words and word shingles of texts as numbers, for Python operators."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def word_codes(words: list[str]) -> np.ndarray:
    """A 64-bit number for each word; equal words have equal numbers, in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    codes, names = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(names, categorize=False)[codes]


def shingles(texts: list[str], width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, its distinct shingles as sorted numbers, and how often each occurs. A text of fewer words has one shingle, of all its words; one without words has none."""
    found = [WORDS.findall(t) for t in texts]
    sizes = [len(f) for f in found]
    codes = word_codes([w for f in found for w in f])
    out, at = [], 0
    for n in sizes:
        own = codes[at : at + n]
        at += n
        k = min(width, n)
        if not n:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        x = own[: n - k + 1].copy()
        for j in range(1, k):
            x = x * _STEP + own[j : n - k + 1 + j]
        out.append(np.unique(mixed(x), return_counts=True))
    return out
