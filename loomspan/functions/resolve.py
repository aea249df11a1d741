"""Entities of a document's chunks put together: an ordered, guarded union of (chunk, id) nodes."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

from ..config import SURNAME_TYPES
from .names import described, generic, identifying, normalised, pronoun, tokens

Node = tuple[int, str]


@dataclass
class Entity:
    chunk: int
    id: str
    type: str
    name: str
    mentions: list[tuple[str, int | None]] = field(default_factory=list)

    @property
    def node(self) -> Node:
        return self.chunk, self.id

    def surfaces(self) -> list[str]:
        return [m for m, _ in self.mentions]

    def all_generic(self) -> bool:
        return bool(self.mentions) and all(map(generic, self.surfaces()))

    def descriptions(self) -> list[str]:
        return [described(m) for m in self.surfaces() if generic(m) and not pronoun(m)]

    def keys(self) -> list[str]:
        own = ([normalised(self.name)] if not generic(self.name) else []) + [normalised(m) for m in self.surfaces() if identifying(m)]
        return sorted(set(own) - {""})


class Groups:
    """Components that never hold two entities of one chunk, unless a union is forced."""

    def __init__(self, nodes: list[Node]):
        self.of = {n: n for n in nodes}
        self.held = {n: [n] for n in nodes}
        self.chunks = {n: {n[0]} for n in nodes}
        self.log: list[tuple[str, Node, Node]] = []

    def join(self, a: Node, b: Node, rule: str, force: bool = False) -> bool:
        x, y = self.of[a], self.of[b]
        if x == y:
            return True
        if not force and self.chunks[x] & self.chunks[y]:
            return False
        for n in self.held[y]:
            self.of[n] = x
        self.held[x] += self.held.pop(y)
        self.chunks[x] |= self.chunks.pop(y)
        self.log.append((rule, a, b))
        return True


def _star(groups: Groups, nodes: list[Node], rule: str) -> None:
    for n in nodes[1:]:
        groups.join(nodes[0], n, rule)


def _by_names(groups: Groups, entities: list[Entity]) -> None:
    """Equal full names; a surname with the one full name that holds it, or with itself where none does."""
    full: dict[tuple[str, str], list[Node]] = defaultdict(list)
    for e in entities:
        for k in e.keys():
            full[e.type, k].append(e.node)
    holding: dict[tuple[str, str], set[str]] = defaultdict(set)
    for kind, k in full:
        words = k.split()
        if len(words) > 1:
            for w in words:
                holding[kind, w].add(k)
    for (kind, k), nodes in sorted(full.items()):
        if " " in k:
            _star(groups, nodes, "b")
    for (kind, k), nodes in sorted(full.items()):
        if " " in k:
            continue
        names = holding[kind, k]
        if len(names) == 1:
            first = full[kind, next(iter(names))][0]
            for n in nodes:
                groups.join(first, n, "b", force=kind in SURNAME_TYPES)
        elif not names:
            _star(groups, nodes, "b")


def _by_descriptions(groups: Groups, entities: list[Entity]) -> None:
    """A described entity joins the only other group of its type with that description in its own or a neighbouring chunk."""
    of, chunks = dict(groups.of), {g: set(c) for g, c in groups.chunks.items()}
    having: dict[tuple[str, str], set[Node]] = defaultdict(set)
    for e in entities:
        for d in e.descriptions():
            having[e.type, d].add(of[e.node])
    found = []
    for e in entities:
        if e.all_generic() and e.descriptions():
            own = of[e.node]
            near = {e.chunk - 1, e.chunk, e.chunk + 1}
            others = {g for d in e.descriptions() for g in having[e.type, d] if g != own and not chunks[g] & chunks[own] and chunks[g] & near}
            if len(others) == 1:
                found.append((next(iter(others)), e.node))
    for a, b in found:
        groups.join(a, b, "c")


def _by_head_nouns(groups: Groups, entities: list[Entity], same_chunk: bool = False) -> None:
    """A lone described entity joins the only named group with its head noun, in the nearest chunk at or before its own that has one.

    An index by type and word holds the chunks where named groups are, in order, and the groups of each.
    """
    of, sizes = dict(groups.of), {g: len(n) for g, n in groups.held.items()}
    names: dict[Node, set[str]] = defaultdict(set)
    places: dict[Node, set[int]] = defaultdict(set)
    kinds: dict[Node, tuple[Node, str]] = {}
    for e in entities:
        g = of[e.node]
        names[g].update(w.casefold() for m in e.surfaces() if identifying(m) for w in tokens(m))
        places[g].add(e.chunk)
        kinds[g] = min(kinds.get(g, (e.node, e.type)), (e.node, e.type))
    there: dict[tuple[str, str], dict[int, set[Node]]] = defaultdict(lambda: defaultdict(set))
    for g, words in names.items():
        for word in words:
            for chunk in places[g]:
                there[kinds[g][1], word][chunk].add(g)
    chunks = {key: sorted(found) for key, found in there.items()}
    for e in entities:
        g = of[e.node]
        if names[g] or sizes[g] > 1 or not e.all_generic():
            continue
        keys = [key for d in e.descriptions() if (key := (e.type, d.split()[-1])) in there]
        earlier = [(chunks[key][k - 1], key) for key in keys if (k := bisect_right(chunks[key], e.chunk))]
        if earlier:
            nearest = max(chunk for chunk, _ in earlier)
            found = set().union(*(there[key][nearest] for chunk, key in earlier if chunk == nearest))
            if len(found) == 1:
                groups.join(found.pop(), e.node, "d", force=same_chunk)


def resolve(entities: list[Entity], carried: bool = False, carry_forward: bool = True, same_chunk: bool = False) -> Groups:
    """Groups of a document's entities, which are in order of chunk and listing. The rules apply in turn and each is logged."""
    groups = Groups([e.node for e in entities])
    if carried:
        by_id: dict[str, list[Node]] = defaultdict(list)
        for e in entities:
            by_id[e.id].append(e.node)
        for nodes in by_id.values():
            _star(groups, nodes, "0")
    anchored: dict[tuple, list[Node]] = defaultdict(list)
    for e in entities:
        for m, at in e.mentions:
            if at is not None and not generic(m):
                anchored[e.type, at, m.casefold()].append(e.node)
    for nodes in anchored.values():
        _star(groups, nodes, "a")
    _by_names(groups, entities)
    _by_descriptions(groups, entities)
    if carry_forward:
        _by_head_nouns(groups, entities, same_chunk)
    return groups


def best_name(names: list[str]) -> str:
    """The longest name that is no description; the first of equals."""
    return max([n for n in names if not generic(n)] or names, key=len, default="")
