"""Answers against a schema and a text: what is kept, retyped or dropped, and the counts of each."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..config import MODALITIES, SWAP_TYPES
from ..operators.ontology import Schema
from .answers import MAX_ENTITIES, MAX_MENTIONS, MAX_RELATIONS, decode
from .matching import find_all, resolve_spans


@dataclass
class Result:
    """One chunk's outcome. error is null, or says what was wrong with the whole answer."""

    entities: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    error: str | None = None
    over_cap: bool = False
    unknown_types: int = 0
    dropped_relations: int = 0
    illegal_relations: int = 0
    repaired_relations: int = 0
    retyped_entities: int = 0
    unresolved_mentions: int = 0
    unresolved_evidence: int = 0
    spans: dict[str, list[tuple[int, int]]] = field(default_factory=dict)


def strict_errors(entities: list[dict], relations: list[dict], schema: Schema) -> list[str]:
    """Every rule that a label breaks: ids once, types of the schema, ends that exist, legal pairs."""
    types = {e.name for e in schema.entities}
    ids = [e["id"] for e in entities]
    of = {e["id"]: e["type"] for e in entities}
    out = [f"id {i} twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    out += [f"unknown type {e['type']}" for e in entities if e["type"] not in types]
    for r in relations:
        if schema.relation(r["type"]) is None:
            out.append(f"unknown relation {r['type']}")
        elif r["source"] not in of or r["target"] not in of:
            out.append(f"{r['type']} without an end")
        elif not schema.legal(r["type"], of[r["source"]], of[r["target"]]):
            out.append(f"{r['type']} from {of[r['source']]} to {of[r['target']]}")
    return out


def retyped(entities: list[dict], relations: list[dict], schema: Schema) -> dict[str, str]:
    """New types of people, organisations and places under which more of their relations become legal and none stops being so; others' types count as they were."""
    of = {e["id"]: e["type"] for e in entities}
    out = {}
    for e in entities:
        if e["type"] not in SWAP_TYPES:
            continue
        own = [r for r in relations if (r["source"] == e["id"]) != (r["target"] == e["id"]) and schema.relation(r["type"]) and r["source"] in of and r["target"] in of]

        def allowed(kind: str, own=own, e=e) -> set[int]:
            end = lambda i: kind if i == e["id"] else of[i]
            return {k for k, r in enumerate(own) if schema.legal(r["type"], end(r["source"]), end(r["target"]))}

        now = allowed(e["type"])
        for kind in SWAP_TYPES:
            if kind != e["type"] and allowed(kind) > now:
                out[e["id"]] = kind
                break
    return out


def _entity_ok(e: object) -> bool:
    return isinstance(e, dict) and all(isinstance(e.get(k), str) for k in ("id", "type", "name")) and isinstance(e.get("mentions"), list) and bool(e["mentions"]) and all(isinstance(m, str) for m in e["mentions"])


def lenient(found: dict, schema: Schema, repair: bool = True, retype: bool = True) -> Result:
    """What of a decoded answer the schema allows. Broken entity records, too many of them and repeated ids fail the whole."""
    out = Result()
    given = found.get("entities", [])
    if not isinstance(given, list) or not all(map(_entity_ok, given)):
        out.error = "schema: an entity lacks a field"
        return out
    for n, most, what in ((len(given), MAX_ENTITIES, "entities"), (max((len(e["mentions"]) for e in given), default=0), MAX_MENTIONS, "mentions")):
        if n > most:
            out.error, out.over_cap = f"schema: at most {most} {what}", True
            return out
    types = {e.name for e in schema.entities}
    entities = [{"attributes": {}} | e for e in given if e["type"] in types]
    out.unknown_types = len(given) - len(entities)
    if len({e["id"] for e in entities}) < len(entities):
        out.error = "schema: an id twice"
        return out
    relations = found.get("relations", [])
    sound = [r for r in relations if isinstance(r, dict) and all(isinstance(r.get(k), str) for k in ("type", "source", "target", "evidence")) and r.get("modality", "asserted") in MODALITIES]
    out.dropped_relations = len(relations) - len(sound)
    told = [r for r in relations if isinstance(r, dict) and all(isinstance(r.get(k), str) for k in ("type", "source", "target"))]
    new = retyped(entities, told, schema) if retype else {}
    out.retyped_entities = len(new)
    out.entities = [e | {"type": new.get(e["id"], e["type"])} for e in entities]
    of = {e["id"]: e["type"] for e in out.entities}
    for r in sound:
        r = {"attributes": {}, "modality": "asserted"} | r
        ends = of.get(r["source"]), of.get(r["target"])
        if schema.relation(r["type"]) is None or None in ends:
            out.dropped_relations += 1
            continue
        if not schema.legal(r["type"], *ends):
            edge = schema.only_edge(*ends) if repair else None
            if edge is None:
                out.dropped_relations += 1
                out.illegal_relations += 1
                continue
            keys = schema.relation(edge).attributes
            r = r | {"type": edge, "attributes": {k: v for k, v in r["attributes"].items() if k in keys}}
            out.repaired_relations += 1
        out.relations.append(r)
    out.dropped_relations += max(0, len(out.relations) - MAX_RELATIONS)
    out.relations = out.relations[:MAX_RELATIONS]
    return out


def finish(fmt: str, raw: str, text: str, schema: Schema, repair: bool = True) -> Result:
    """An answer decoded, checked and located: surfaces that don't occur go, entities without a span, and relations without an end or whose evidence the text lacks."""
    found, wrong = decode(fmt, raw, text)
    if found is None:
        return Result(error=wrong)
    out = lenient(found, schema, repair)
    if out.error:
        return out
    out.spans, _ = resolve_spans(text, {e["id"]: e["mentions"] for e in out.entities})
    kept = []
    for e in out.entities:
        there = [m for m in e["mentions"] if find_all(text, m)]
        out.unresolved_mentions += len(e["mentions"]) - len(there)
        if there and out.spans[e["id"]]:
            kept.append(e | {"mentions": there})
    ids = {e["id"] for e in kept}
    sound = [r for r in out.relations if r["source"] in ids and r["target"] in ids]
    out.dropped_relations += len(out.relations) - len(sound)
    stated = [r for r in sound if r["evidence"] in text]
    out.unresolved_evidence = len(sound) - len(stated)
    out.entities, out.relations = kept, stated
    out.spans = {i: s for i, s in out.spans.items() if i in ids}
    return out


def project(entities: list[dict], relations: list[dict], window: str) -> tuple[list[dict], list[dict]]:
    """Gold inside a window, by substring: mentions in it, entities with one, relations with both ends and their evidence."""
    own = [e | {"mentions": m} for e in entities if (m := [x for x in e["mentions"] if x in window])]
    ids = {e["id"] for e in own}
    return own, [r for r in relations if r["source"] in ids and r["target"] in ids and r["evidence"] in window]
