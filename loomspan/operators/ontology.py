"""Typed schemas: built and checked on the driver, used as small dimension tables."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EntityType:
    name: str
    definition: str = ""
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelationType:
    """ends: (source type, target type) pairs that are legal."""

    name: str
    ends: tuple[tuple[str, str], ...]
    definition: str = ""
    symmetric: bool = False
    attributes: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    paraphrases: tuple[str, ...] = ()


def edge_name(camel: str) -> str:
    """OwnsStakeIn -> OWNS_STAKE_IN."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", camel).upper()


def relation(name: str, sources: str, targets: str, definition: str = "", **more) -> RelationType:
    """A relation legal between every source and target type; types are separated by |."""
    ends = tuple((s, t) for s in sources.split("|") for t in targets.split("|"))
    return RelationType(edge_name(name) if not name.isupper() else name, ends, " ".join(definition.split()), **more)


def following(definition: str, named: dict[str, str], dropped: Iterable[str]) -> str:
    """A definition under a variant: relations by the names that they have there, and without clauses, but for the first, that name a type that is gone. A plural counts as the type."""
    gone = set(dropped)
    known = sorted({*named, *gone}, key=len, reverse=True)
    if not known:
        return definition
    mention = re.compile(rf"\b({'|'.join(map(re.escape, known))})(s?)\b")
    first, *more = (c.strip() for c in definition.split(";"))
    kept = [first, *(c for c in more if not any(m[1] in gone for m in mention.finditer(c)))]
    return "; ".join(mention.sub(lambda m: named.get(m[1], m[1]) + m[2], c) for c in kept)


@dataclass(frozen=True)
class Schema:
    name: str
    entities: tuple[EntityType, ...]
    relations: tuple[RelationType, ...]
    _by_name: dict = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        types = [e.name for e in self.entities]
        edges = [r.name for r in self.relations]
        for kind, names in (("entity", types), ("relation", edges)):
            if twice := sorted({n for n in names if names.count(n) > 1}):
                raise ValueError(f"{self.name}: {kind} type named twice: {twice}")
        if both := sorted(set(types) & set(edges)):
            raise ValueError(f"{self.name}: both an entity and a relation: {both}")
        for r in self.relations:
            if unknown := sorted({x for pair in r.ends for x in pair} - set(types)):
                raise ValueError(f"{self.name}: {r.name} has unknown ends: {unknown}")
        taken: dict[str, str] = {n: n for n in types + edges}
        for r in self.relations:
            for a in r.aliases:
                if a in taken:
                    raise ValueError(f"{self.name}: alias {a} of {r.name} is taken by {taken[a]}")
                taken[a] = r.name
        self._by_name.update({r.name: r for r in self.relations})

    def relation(self, name: str) -> RelationType | None:
        return self._by_name.get(name)

    def legal(self, edge: str, source: str, target: str) -> bool:
        r = self._by_name.get(edge)
        return r is not None and (source, target) in r.ends

    def only_edge(self, source: str, target: str) -> str | None:
        """The one edge that is legal between two types, if there is just one."""
        found = [r.name for r in self.relations if (source, target) in r.ends]
        return found[0] if len(found) == 1 else None

    def symmetric(self) -> frozenset[str]:
        return frozenset(r.name for r in self.relations if r.symmetric)

    def attribute_keys(self) -> list[str]:
        return sorted({a for r in self.relations for a in r.attributes})

    def canonical(self, edge: str, source: str | None, target: str | None) -> tuple:
        """Ends of a symmetric edge in order; an unknown end leaves it as it is."""
        r = self._by_name.get(edge)
        swap = r is not None and r.symmetric and source is not None and target is not None and str(target) < str(source)
        return (edge, target, source) if swap else (edge, source, target)

    def markdown(self) -> str:
        rows = [f"| {r.name} | {', '.join(f'{s} → {t}' for s, t in r.ends)} | {'yes' if r.symmetric else ''} | {r.definition} |" for r in self.relations]
        return "\n".join([f"# {self.name}", "", "| relation | ends | symmetric | definition |", "|---|---|---|---|", *rows])

    def described(self) -> str:
        """The text that tells a proposer what to look for."""
        nodes = [f"- {e.name}: {e.definition}" + (f" (required: {', '.join(e.required)})" if e.required else "") for e in self.entities]
        edges = []
        for r in self.relations:
            notes = [f"attributes: {', '.join(r.attributes)}"] * bool(r.attributes) + ["symmetric"] * r.symmetric
            edges.append(f"- {r.name} ({'; '.join(f'{s} -> {t}' for s, t in r.ends)}): {r.definition}" + (f" [{'; '.join(notes)}]" if notes else ""))
        return "\n".join(["Node types:", *nodes, "", "Edge types:", *edges])

    def sources(self, edge: str) -> list[str]:
        return sorted({s for s, _ in self._by_name[edge].ends})

    def targets(self, edge: str) -> list[str]:
        return sorted({t for _, t in self._by_name[edge].ends})

    def rendered(self) -> str:
        """The short text for conditioned prompts: entity types, then relation types with their ends."""
        nodes = [f"- {e.name}: {e.definition}" + f" (required attributes: {', '.join(e.required)})" * bool(e.required) for e in self.entities]
        edges = [f"- {r.name}: {'|'.join(self.sources(r.name))} -> {'|'.join(self.targets(r.name))}. {r.definition}" + f"; attributes: {', '.join(r.attributes)}" * bool(r.attributes) for r in self.relations]
        return "\n".join(["Entity types:", *nodes, "Relation types (source -> target):", *edges])

    def as_json(self) -> dict:
        """The schema itself: what each type means, needs and may connect."""
        nodes = {e.name: {"description": e.definition, "required": list(e.required)} for e in self.entities}
        edges = {r.name: {"description": r.definition, "attributes": list(r.attributes), "sources": self.sources(r.name), "targets": self.targets(r.name), "symmetric": r.symmetric} for r in self.relations}
        return {"name": self.name, "entities": nodes, "relations": edges}

    def json_schema(self) -> dict:
        """What a valid answer in JSON looks like."""
        strings = {"type": "object", "additionalProperties": {"type": "string"}}
        entity = {"id": {"type": "string"}, "type": {"enum": [e.name for e in self.entities]}, "name": {"type": "string"}, "attributes": strings, "mentions": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 12}}
        edge = {"type": {"enum": [r.name for r in self.relations]}, "source": {"type": "string"}, "target": {"type": "string"}, "attributes": strings, "modality": {"enum": ["asserted", "negated", "hedged", "reported"]}, "evidence": {"type": "string"}}
        many = lambda p, need: {"type": "array", "maxItems": 40, "items": {"type": "object", "properties": p, "required": need}}
        return {"type": "object", "required": ["entities", "relations"], "properties": {"entities": many(entity, ["id", "type", "name", "mentions"]), "relations": many(edge, ["type", "source", "target", "modality", "evidence"])}}

    def without(self, relations: Iterable[str] = (), entities: Iterable[str] = (), name: str | None = None) -> tuple[Schema, dict[str, str]]:
        """The schema without these types, and the relations that stay: one needs a legal pair of ends that stay, and an entity type that loses all its relations goes too."""
        gone = set(relations), set(entities)
        linked = {x for r in self.relations for pair in r.ends for x in pair}
        kept = []
        for r in self.relations:
            ends = tuple(pair for pair in r.ends if not gone[1] & set(pair))
            if r.name not in gone[0] and ends:
                kept.append(replace(r, ends=ends))
        used = {x for r in kept for pair in r.ends for x in pair}
        nodes = tuple(e for e in self.entities if e.name not in gone[1] and (e.name in used or e.name not in linked))
        dropped = {r.name for r in self.relations} - {r.name for r in kept} | {e.name for e in self.entities} - {e.name for e in nodes}
        names = {r.name: r.name for r in kept}
        out = tuple(replace(r, definition=following(r.definition, names, dropped)) for r in kept)
        return Schema(name or f"{self.name}~reduced", nodes, out), names

    def variant(self, seed: int, drop: float = 0.25, rename: float = 0.3, rephrase: float = 0.3) -> tuple[Schema, dict[str, str]]:
        """A sub-schema by a seeded draw: some relations go, some take an alias or a paraphrase, the order changes. Also the new name of each relation that stays."""
        rng = random.Random(seed)
        kept = [r for r in self.relations if rng.random() >= drop] or [rng.choice(self.relations)]
        named, out = {}, []
        for r in rng.sample(kept, len(kept)):
            named[r.name] = rng.choice(r.aliases) if r.aliases and rng.random() < rename else r.name
            text = rng.choice(r.paraphrases) if r.paraphrases and rng.random() < rephrase else r.definition
            out.append(replace(r, name=named[r.name], aliases=(), definition=text))
        used = {x for r in out for pair in r.ends for x in pair}
        dropped = {r.name for r in self.relations} - named.keys() | {e.name for e in self.entities} - used
        out = [replace(r, definition=following(r.definition, named, dropped)) for r in out]
        return Schema(f"{self.name}~{seed}", tuple(e for e in self.entities if e.name in used), tuple(out)), named

    # --- dimension tables ---

    def dim_entity_type(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.name, e.name, e.definition, list(e.required)) for e in self.entities], "schema string, type string, definition string, required array<string>")

    def dim_relation_type(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, r.name, r.definition, r.symmetric, list(r.attributes), list(r.aliases), list(r.paraphrases), k) for k, r in enumerate(self.relations)]
        return spark.createDataFrame(rows, "schema string, type string, definition string, symmetric boolean, attributes array<string>, aliases array<string>, paraphrases array<string>, ord int")

    def dim_legal(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, r.name, s, t) for r in self.relations for s, t in dict.fromkeys(r.ends)]
        return spark.createDataFrame(rows, "schema string, rel_type string, src_type string, tgt_type string")


_registry: dict[str, Schema] = {}


def register(schema: Schema) -> Schema:
    _registry[schema.name] = schema
    return schema


def registered(name: str) -> Schema:
    """Only what was registered here: a name in data never loads code."""
    if name not in _registry:
        raise KeyError(f"no schema {name!r}; registered: {sorted(_registry)}")
    return _registry[name]


def all_registered() -> dict[str, Schema]:
    return dict(_registry)


def only_edges(legal: DataFrame) -> DataFrame:
    """src_type, tgt_type and the one edge legal between them."""
    return legal.groupBy("schema", "src_type", "tgt_type").agg(F.count("*").alias("n"), F.min("rel_type").alias("rel_type")).where("n = 1").drop("n")


def neighbour_types(legal: DataFrame) -> DataFrame:
    """type, other: relations that are legal for one of the type's end pairs too."""
    a, b = legal.alias("a"), legal.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("schema", "src_type", "tgt_type")]
    return a.join(b, on).where("a.rel_type != b.rel_type").select(F.col("a.rel_type").alias("type"), F.col("b.rel_type").alias("other")).distinct()


def label_classes(types: DataFrame) -> DataFrame:
    """type, direction: both directions of directed relations, one of symmetric ones."""
    return types.select("type", F.explode(F.when(F.col("symmetric"), F.array(F.lit(">"))).otherwise(F.array(F.lit(">"), F.lit("<")))).alias("direction"))


def legal_only(relations: DataFrame, legal: DataFrame) -> DataFrame:
    """Relations (type, src_type, tgt_type, …) that the schema allows."""
    allowed = legal.select(F.col("rel_type").alias("type"), "src_type", "tgt_type").distinct()
    return relations.join(F.broadcast(allowed), ["type", "src_type", "tgt_type"], "left_semi")  # a schema's size, whatever the data


def canonical_ends(symmetric: Column, source: Column, target: Column) -> tuple[Column, Column]:
    swap = symmetric & source.isNotNull() & target.isNotNull() & (target < source)
    return F.when(swap, target).otherwise(source), F.when(swap, source).otherwise(target)


def map_types(relations: DataFrame, named: dict[str, str]) -> DataFrame:
    """Gold under a variant: relations that stay, under their new names."""
    pairs = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    return relations.withColumn("type", pairs[F.col("type")]).where("type is not null")


def gold_under(entities: DataFrame, relations: DataFrame, schema: Schema, named: dict[str, str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Gold (keys, ent_id, type; keys, type, source, target) under a variant: entities of types that stay, and relations that stay, under
    their new names, between two of these and legal there."""
    kept = entities.where(F.col("type").isin(*(e.name for e in schema.entities)))
    end = lambda k: kept.select(*keys, F.col("ent_id").alias(k), F.col("type").alias({"source": "src_type", "target": "tgt_type"}[k]))
    placed = map_types(relations, named).join(end("source"), [*keys, "source"]).join(end("target"), [*keys, "target"])
    return kept, legal_only(placed, schema.dim_legal(relations.sparkSession)).select(*relations.columns)


def training_view(entities: DataFrame, relations: DataFrame, schema: Schema, keys: list[str], held_out: dict | None = None, seed: int | None = None) -> tuple[DataFrame, DataFrame, Schema] | None:
    """Gold and schema as training sees them: without held-out types (held_out: schemas, relations, entities), then, with a seed, under a random variant. None where the schema is held out."""
    held = held_out or {}
    if schema.name in held.get("schemas", ()):
        return None
    if held.get("relations") or held.get("entities"):
        small, named = schema.without(held.get("relations", ()), held.get("entities", ()))
        entities, relations = gold_under(entities, relations, small, named, keys)
        schema = small
    if seed is not None:
        drawn, named = schema.variant(seed)
        entities, relations = gold_under(entities, relations, drawn, named, keys)
        schema = drawn
    return entities, relations, schema


# --- the coarse view ---

# Entity types and relation types of the view; a founder owns an organisation if it is one itself.
COARSE_ENTITY = {"Person": "Person", "Org": "Org", "Place": "Place"}
COARSE_SYMMETRIC = frozenset({"FAMILY_OF", "ASSOCIATED_WITH"})
COARSE_RELATION = {
    "EMPLOYED_BY": "AFFILIATED_WITH", "EXECUTIVE_OF": "AFFILIATED_WITH", "BOARD_MEMBER_OF": "AFFILIATED_WITH", "MEMBER_OF": "AFFILIATED_WITH",
    "OWNS_STAKE_IN": "OWNS", "ACQUIRED": "OWNS", "SUBSIDIARY_OF": "PART_OF", "LOCATED_IN": "LOCATED_IN", "BORN_IN": "LOCATED_IN",
    "OPERATES_IN": "LOCATED_IN", "HEADQUARTERED_IN": "LOCATED_IN", "FAMILY_OF": "FAMILY_OF", "ASSOCIATE_OF": "ASSOCIATED_WITH",
    "MET_WITH": "ASSOCIATED_WITH", "COMMUNICATED_WITH": "ASSOCIATED_WITH",
}


def coarse_rendered() -> str:
    """The coarse view as text."""
    of: dict[str, list[str]] = {}
    for fine, coarse in [*COARSE_RELATION.items(), ("FOUNDED", "AFFILIATED_WITH"), ("FOUNDED", "OWNS")]:
        of.setdefault(coarse, []).append(fine)
    lines = [f"- {coarse}{' (symmetric)' if coarse in COARSE_SYMMETRIC else ''}: {', '.join(fine)}" for coarse, fine in sorted(of.items())]
    return "\n".join([f"Entity types: {', '.join(COARSE_ENTITY)}", "Relation types, and what each holds:", *lines])


def coarsen(relations: DataFrame, keys: list[str]) -> DataFrame:
    """Relations (keys, ord, source, target, type, src_type, tgt_type) in the coarse view, the first of equals, with fine_type.

    FOUNDED depends on its source: an organisation owns what it founded, any other is affiliated with it.
    """
    pairs = F.create_map(*(F.lit(x) for kv in COARSE_RELATION.items() for x in kv))
    founded = F.when(F.col("src_type") == "Org", F.lit("OWNS")).otherwise(F.lit("AFFILIATED_WITH"))
    known = F.col("src_type").isin(*COARSE_ENTITY) & F.col("tgt_type").isin(*COARSE_ENTITY)
    df = relations.where(known).withColumn("coarse", F.when(F.col("type") == "FOUNDED", founded).otherwise(pairs[F.col("type")])).where("coarse is not null")
    a, b = canonical_ends(F.col("coarse").isin(*COARSE_SYMMETRIC), F.col("source"), F.col("target"))
    w = W.partitionBy(*keys, "coarse", a, b).orderBy("ord")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumnRenamed("type", "fine_type").withColumnRenamed("coarse", "type")


def from_rows(name: str, entities: Iterable[str], relations: Iterable[RelationType]) -> Schema:
    return register(Schema(name, tuple(EntityType(*e.split(": ", 1)) for e in entities), tuple(relations)))
