"""Names found token by token: tags to spans and back, and which mentions of an entity are names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import groupby

from .matching import word_spans

# Marks that a token may carry along after a name, and articles that make no name.
TRAILING = ",.;:!?\"'"
ARTICLES = frozenset({"The", "An"})
WORD = re.compile(r"\w+")

Tagged = tuple[int, int, str]


def labelled_spans(text: str, mentions: Iterable[tuple[str, str]]) -> list[Tagged]:
    """(start, end, type) of whole-word occurrences of (mention, type); longer mentions first, and none over another."""
    free = bytearray(b"\x01" * len(text))
    out: list[Tagged] = []
    for mention, kind in sorted(mentions, key=lambda m: len(m[0]), reverse=True):
        for a, b in word_spans(text, mention):
            if all(free[a:b]):
                free[a:b] = bytes(b - a)
                out.append((a, b, kind))
    return sorted(out)


def name_words(text: str) -> set[str]:
    """Words of a name as written: capitalised, of two letters or more, no articles."""
    return {w for w in WORD.findall(text) if w[:1].isupper() and len(w) > 1} - ARTICLES


def name_mentions(name: str, mentions: Iterable[str]) -> list[str]:
    """The name, and the mentions that share a word of a name with it; pronouns and descriptions share none."""
    own = name_words(name)
    return [name, *(m for m in mentions if m != name and own & name_words(m))]


def encode(text: str, tokens: Sequence[tuple[int, int]], gold: Iterable[Tagged]) -> list[str]:
    """The tag of each token (start, end): B- where an entity begins in it, I- inside one, O elsewhere. The first span that a token meets counts."""
    spans, tags = list(gold), []
    for a, b in tokens:
        hit = next(((s, kind) for s, e, kind in spans if s < b and a < e), None)
        body = b - len(text[a:b].lstrip())  # tokens may begin with the blank before a word
        tags.append("O" if hit is None else f"{'B' if body <= hit[0] else 'I'}-{hit[1]}")
    return tags


def _snapped(text: str, a: int, b: int) -> tuple[int, int]:
    """A span out to the ends of its words, but not over a line break, without blanks before it and marks after it."""
    a += len(text[a:b]) - len(text[a:b].lstrip())
    while a and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and (text[b].isalnum() or text[b] in "-'"):
        b += 1
    own = text[a:b].partition("\n")[0]
    return a, a + len(own.rstrip(TRAILING))


def decode(text: str, tokens: Sequence[tuple[int, int]], tags: Sequence[str]) -> list[Tagged]:
    """Spans of runs of tags: a run begins at B-, and at an I- of another type than the tag before. Spans are snapped to words."""
    runs, number, last = [], 0, "O"
    for tag in tags:
        kind = tag[2:]
        number += tag[0] == "B" or tag[0] == "I" and kind != last
        last = kind if tag[0] in "BI" else "O"
        runs.append((number, kind) if tag[0] in "BI" else None)
    out = []
    for run, places in groupby(range(len(tokens)), key=lambda k: runs[k]):
        if run is not None:
            own = list(places)
            a, b = _snapped(text, tokens[own[0]][0], tokens[own[-1]][1])
            if text[a:b].strip():
                out.append((a, b, run[1]))
    return out
