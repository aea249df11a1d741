"""Three ways to find a name in a text, and the claims of names on its parts."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import lru_cache

Span = tuple[int, int]


@lru_cache(4096)
def _spaced(needle: str) -> re.Pattern:
    return re.compile(r"\s+".join(map(re.escape, needle.split())))


def find_all(text: str, needle: str) -> list[Span]:
    """Whole-word occurrences without overlap. White space in the needle matches any run; a side is checked only if the needle ends in a letter or digit there."""
    if not needle.strip():
        return []
    pattern, out, at = _spaced(needle), [], 0
    body = needle.strip()
    left, right = body[0].isalnum(), body[-1].isalnum()
    while m := pattern.search(text, at):
        a, b = m.span()
        joined = left and a and text[a - 1].isalnum() or right and b < len(text) and text[b].isalnum()
        if not joined:
            out.append((a, b))
        at = a + 1 if joined else b
    return out


def word_spans(text: str, needle: str) -> list[Span]:
    """Literal occurrences between word boundaries, where letters, digits and underscores make words."""
    return [m.span() for m in re.finditer(rf"(?<!\w){re.escape(needle)}(?!\w)", text)] if needle else []


def locate(text: str, needle: str, headings: list[Span], shift: int = 0) -> list[int | None]:
    """Offsets of a name in the document; those inside headings only where there are no others; [None] where there is none."""
    found = [a for a, _ in word_spans(text, needle)]
    body = [a for a in found if not any(s <= a < e for s, e in headings)]
    return [a + shift for a in body or found] or [None]


def place_generic(hits: list[int], anchors: list[int]) -> int | None:
    """The hit that follows a name most closely; hits before every name come last."""
    return min(hits, key=lambda h: min((h - a if h >= a else a - h + 1e9 for a in anchors), default=0), default=None)


class Taken:
    """Disjoint spans that are claimed already."""

    def __init__(self) -> None:
        self.spans: list[Span] = []

    def claim(self, span: Span) -> bool:
        k = bisect_left(self.spans, span)
        free = (k == 0 or self.spans[k - 1][1] <= span[0]) and (k == len(self.spans) or span[1] <= self.spans[k][0])
        if free:
            insort(self.spans, span)
        return free


def resolve_spans(text: str, surfaces: dict[str, list[str]]) -> tuple[dict[str, list[Span]], int]:
    """Spans of each entity's surfaces, the longest surface first (then the lower id, as text, and surface), and how many surfaces occur nowhere."""
    order = sorted((-len(s), i, s) for i, own in surfaces.items() for s in own)
    taken, out, missing = Taken(), {i: [] for i in surfaces}, 0
    for _, i, surface in order:
        hits = find_all(text, surface)
        missing += not hits
        out[i] += [h for h in hits if taken.claim(h)]
    return {i: sorted(s) for i, s in out.items()}, missing


def longest_spans(text: str, names: Iterable[str]) -> list[tuple[int, int, str]]:
    """Word-bounded spans of names, longer names first, without overlap."""
    taken, out = Taken(), []
    for name in sorted(set(names), key=lambda s: (-len(s), s)):
        out += [(a, b, name) for a, b in word_spans(text, name) if taken.claim((a, b))]
    return sorted(out)
