"""Answers of proposers as tables: decoded, checked against schemas, located in their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, validate
from ..functions.matching import locate, place_generic
from ..functions.names import generic
from ..functions.segment import heading_spans
from .ontology import all_registered, registered
from . import schemas as _bundled  # noqa: F401  registers the bundled schemas
from .rows import flat_map

ENTITY = "struct<id: string, type: string, name: string, attributes: map<string, string>, mentions: array<string>>"
RELATION = "struct<type: string, source: string, target: string, modality: string, evidence: string, attributes: map<string, string>>"
COUNTS = ("unknown_types", "dropped_relations", "illegal_relations", "repaired_relations", "retyped_entities", "unresolved_mentions", "unresolved_evidence")
RESULTS = f"entities array<{ENTITY}>, relations array<{RELATION}>, spans map<string, array<struct<start: int, end: int>>>, error string, over_cap boolean, " + ", ".join(f"{c} int" for c in COUNTS)


def results(given: DataFrame, repair: bool = True, key: str = "chunk_id") -> DataFrame:
    """Answers (key, text, raw, fmt, schema) -> key and what each says, or its error. A null answer is an error; an unregistered schema fails the job."""
    schemas = all_registered()  # as the driver knows them now; executors register none

    def make(text, raw, fmt, schema):
        if raw is None:
            r = validate.Result(error="no answer")
        else:
            r = validate.finish(fmt or "sentences", raw, text or "", schemas[schema or "business"], repair)
        spans = [(i, [{"start": a, "end": b} for a, b in s]) for i, s in r.spans.items()]
        entity = [e | {"attributes": list(e["attributes"].items())} for e in r.entities]
        relation = [x | {"attributes": list(x["attributes"].items())} for x in r.relations]
        yield (entity, relation, spans, r.error, r.over_cap, *(getattr(r, c) for c in COUNTS))

    return flat_map(given, [key], ["text", "raw", "fmt", "schema"], make, RESULTS)


def entities_of(result: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, ord, ent_id, type, name, attributes, mentions."""
    e = result.select(key, F.posexplode("entities").alias("ord", "e"))
    return e.select(key, "ord", F.col("e.id").alias("ent_id"), "e.type", "e.name", "e.attributes", "e.mentions")


def relations_of(result: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, ord, type, source, target, modality, evidence, attributes."""
    return result.select(key, F.posexplode("relations").alias("ord", "r")).select(key, "ord", "r.*")


def encoded(result: DataFrame, fmt: str, schema: str = "business", key: str = "chunk_id") -> DataFrame:
    """key and the answer of results (key, text, entities, relations) in a format."""
    keys = registered(schema).attribute_keys()

    def make(text, entities, relations):
        plain = lambda xs: [x | {"attributes": dict(x["attributes"] or {})} for x in xs or []]
        yield (answers.encode(fmt, plain(entities), plain(relations), text or "", keys),)

    return flat_map(result, [key], ["text", "entities", "relations"], make, "answer string")


def rendered(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return flat_map(chunks, [key], ["text"], lambda t: [(answers.rendered(t or ""),)], "prompt string")


def placed(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Entities (keys, ent_id, mentions, text, start) -> keys, ent_id, ord, mention, at: names wherever they occur, descriptions at the one place that follows a name most closely; a null place means the surface isn't there."""

    def make(mentions, text, start):
        heads = heading_spans(text)
        hits = {m: locate(text, m, heads, start) for m in dict.fromkeys(mentions)}
        anchors = [a for m, found in hits.items() if not generic(m) for a in found if a is not None]
        for k, (m, found) in enumerate(hits.items()):
            if generic(m) and len(found) > 1:
                found = [place_generic(found, anchors)]
            yield from ((k, m, a) for a in found)

    return flat_map(entities, [*keys, "ent_id"], ["mentions", "text", "start"], make, "ord int, mention string, at int")


def windows_match(relation_types: DataFrame) -> DataFrame:
    """The attribute keys of all relation types, sorted."""
    return relation_types.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("attributes")))).alias("keys"))
