"""Schemas as rules over tables: which rows of a graph break one, what is dropped, retyped or repaired. All schemas in one pass.

Entities (key, ord, ent_id, type) and relations (key, ord, type, source, target, modality, attributes) of a key follow the schema of that
key (schema_of: key, schema). A schema's rows are its own size, whatever the data, and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MODALITIES, SWAP_TYPES
from ..functions.answers import MAX_RELATIONS
from . import ontology


@dataclass
class Rules:
    """The dimension tables of several schemas: types (schema, type), edges (schema, type, attributes), legal (schema, rel_type, src_type, tgt_type), only (schema, src_type, tgt_type, rel_type, attributes)."""

    types: DataFrame
    edges: DataFrame
    legal: DataFrame
    only: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, schemas: list[ontology.Schema]) -> Rules:
        all_of = lambda make: reduce(DataFrame.unionByName, [make(s) for s in schemas])
        types = all_of(lambda s: s.dim_entity_type(spark)).select("schema", "type")
        edges = all_of(lambda s: s.dim_relation_type(spark)).select("schema", "type", "attributes")
        legal = all_of(lambda s: s.dim_legal(spark))
        only = ontology.only_edges(legal).join(edges.withColumnRenamed("type", "rel_type"), ["schema", "rel_type"])
        return cls(types, edges, legal, only)


def _ends(entities: DataFrame, key: str) -> DataFrame:
    """key and the type of each id, as one map a key; of an id that is there twice the last counts."""
    last = entities.groupBy(key, "ent_id").agg(F.max_by("type", "ord").alias("type"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ent_id", "type"))).alias("type_of"))


def _with_types(relations: DataFrame, entities: DataFrame, schema_of: DataFrame, key: str) -> DataFrame:
    """Relations with schema, src_type and tgt_type; an end that isn't there has a null type."""
    at = lambda end: F.try_element_at("type_of", F.col(end))
    placed = relations.join(schema_of, key).join(_ends(entities, key), key, "left")
    return placed.withColumn("src_type", at("source")).withColumn("tgt_type", at("target")).drop("type_of")


def _legal(relations: DataFrame, rules: Rules) -> DataFrame:
    """Whether the schema has a relation's type (known) and allows it between its ends (allowed)."""
    known = rules.edges.select("schema", "type", F.lit(True).alias("known"))
    allowed = rules.legal.select("schema", F.col("rel_type").alias("type"), "src_type", "tgt_type", F.lit(True).alias("allowed")).distinct()
    both = relations.join(F.broadcast(known), ["schema", "type"], "left").join(F.broadcast(allowed), ["schema", "type", "src_type", "tgt_type"], "left")
    return both.withColumn("known", F.col("known").isNotNull()).withColumn("allowed", F.col("allowed").isNotNull())


def violations(entities: DataFrame, relations: DataFrame, schema_of: DataFrame, rules: Rules, key: str = "chunk_id") -> DataFrame:
    """key, rule, what and n: how often a key's graph breaks a rule, and by what.

    id_twice (the id), unknown_type (an entity's), missing_end (of a relation of that type), unknown_relation and illegal_ends (a relation
    between types that its schema doesn't allow). A relation that lacks an end breaks that rule alone. Keys without a schema are left out.
    """
    ids = entities.join(schema_of, key).groupBy(key, F.col("ent_id").alias("what")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("id_twice").alias("rule"), "what", "n")
    strange = entities.join(schema_of, key).join(F.broadcast(rules.types), ["schema", "type"], "left_anti")
    types = strange.groupBy(key, F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit("unknown_type").alias("rule"), "what", "n")
    judged = _legal(_with_types(relations, entities, schema_of, key), rules)
    there = F.col("src_type").isNotNull() & F.col("tgt_type").isNotNull()
    rule = F.when(~there, "missing_end").when(~F.col("known"), "unknown_relation").when(~F.col("allowed"), "illegal_ends")
    what = F.when(F.col("known") & there, F.concat_ws(" ", "type", "src_type", "tgt_type")).otherwise(F.col("type"))
    broken = judged.withColumn("rule", rule).where("rule is not null").groupBy(key, "rule", what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return ids.unionByName(types).unionByName(broken)


def retypings(entities: DataFrame, relations: DataFrame, schema_of: DataFrame, rules: Rules, key: str = "chunk_id") -> DataFrame:
    """key, ent_id and new_type of entities that their relations show to be mistyped.

    A person, organisation or place takes another of these types if more of its relations are legal then and all that are legal now stay so;
    the first such type of SWAP_TYPES. The other ends count with the types that they have. Relations of an entity with itself don't count.
    """
    of = _with_types(relations, entities, schema_of, key).where("src_type is not null and tgt_type is not null and source != target")
    side = lambda end, this, other: F.struct(F.col(end).alias("ent_id"), F.col(this).alias("now"), F.lit(this).alias("side"), F.col(other).alias("other"))
    sides = F.explode(F.array(side("source", "src_type", "tgt_type"), side("target", "tgt_type", "src_type")))
    incident = of.select(key, "schema", F.col("type").alias("rel_type"), sides.alias("s")).select(key, "schema", "rel_type", "s.*")
    swappable = incident.where(F.col("now").isin(*SWAP_TYPES))
    fits = lambda this, fixed: rules.legal.groupBy("schema", "rel_type", F.col(fixed).alias("other")).agg(F.collect_set(this).alias("fits")).withColumn("side", F.lit(this))
    table = fits("src_type", "tgt_type").unionByName(fits("tgt_type", "src_type"))
    rows = swappable.join(F.broadcast(rules.edges.select("schema", F.col("type").alias("rel_type"))), ["schema", "rel_type"], "left_semi")
    rows = rows.join(F.broadcast(table), ["schema", "rel_type", "other", "side"], "left")
    fit = lambda kind: F.coalesce(F.array_contains("fits", kind if isinstance(kind, Column) else F.lit(kind)), F.lit(False))
    now = fit(F.col("now"))
    more = [(F.count_if(fit(k)) > F.count_if(now)) & F.bool_and(~now | fit(k)) & (F.first("now") != k) for k in SWAP_TYPES]
    chosen = F.coalesce(*(F.when(m, k) for m, k in zip(more, SWAP_TYPES, strict=True)))
    return rows.groupBy(key, "ent_id").agg(chosen.alias("new_type")).where("new_type is not null")


@dataclass
class Lenient:
    """entities and relations that are kept, with their new types; counts: key, unknown_types, retyped, dropped, illegal, repaired, over_cap, error."""

    entities: DataFrame
    relations: DataFrame
    counts: DataFrame


def lenient(entities: DataFrame, relations: DataFrame, schema_of: DataFrame, rules: Rules, repair: bool = True, retype: bool = True, key: str = "chunk_id") -> Lenient:
    """What of each key's graph its schema allows.

    Entities of unknown types go, then some are retyped; relations of an unknown type or modality or without an end go; an illegal one takes
    the only type that is legal between its ends (repair), with the attributes that this type has, or goes; MAX_RELATIONS stay, the
    first ones. A key with an id twice among the entities of known types keeps nothing and has an error. Every key of schema_of has counts.
    """
    typed = entities.join(schema_of, key)
    known = typed.join(F.broadcast(rules.types), ["schema", "type"], "left_semi")
    twice = known.groupBy(key, "ent_id").agg((F.count(F.lit(1)) > 1).alias("twice")).groupBy(key).agg(F.bool_or("twice").alias("twice"))
    if retype:
        changed = retypings(known, relations, schema_of, rules, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("ent_id", "new_type"))).alias("changed"))
        new = F.try_element_at("changed", F.col("ent_id"))
        fresh = known.join(changed, key, "left").withColumn("retyped", new.isNotNull()).withColumn("type", F.coalesce(new, "type")).drop("changed")
    else:
        fresh = known.withColumn("retyped", F.lit(False))
    judged = _legal(_with_types(relations, fresh, schema_of, key), rules)
    only = rules.only.select("schema", "src_type", "tgt_type", F.col("rel_type").alias("only"), F.col("attributes").alias("only_attributes"))
    judged = judged.join(F.broadcast(only), ["schema", "src_type", "tgt_type"], "left")
    sound = F.col("modality").isin(*MODALITIES) & F.col("known") & F.col("src_type").isNotNull() & F.col("tgt_type").isNotNull()
    mended = F.lit(repair) & F.col("only").isNotNull()
    fate = F.when(~F.coalesce(sound, F.lit(False)), "dropped").when(F.col("allowed"), "kept").when(mended, "repaired").otherwise("illegal")
    judged = judged.withColumn("fate", fate).join(twice, key, "left")
    stays = F.col("fate").isin("kept", "repaired")
    nth = F.sum(F.when(stays, 1).otherwise(0)).over(W.partitionBy(key).orderBy("ord"))
    judged = judged.withColumn("kept", stays & (nth <= MAX_RELATIONS))
    mends = F.col("fate") == "repaired"
    kept = judged.where(F.col("kept") & ~F.coalesce("twice", F.lit(False)))
    attributes = F.when(mends, F.map_filter("attributes", lambda k, _: F.array_contains("only_attributes", k))).otherwise(F.col("attributes"))
    out = kept.withColumn("attributes", attributes).withColumn("type", F.when(mends, F.col("only")).otherwise(F.col("type"))).select(*relations.columns)
    of_relations = judged.groupBy(key).agg(
        F.count_if(~F.col("kept")).alias("dropped"), F.count_if(F.col("fate") == "illegal").alias("illegal"), F.count_if(mends).alias("repaired"), F.count_if(stays & ~F.col("kept")).alias("over_cap")
    )
    of_entities = typed.groupBy(key).agg(F.count(F.lit(1)).alias("given"))
    of_known = fresh.groupBy(key).agg(F.count(F.lit(1)).alias("known"), F.count_if("retyped").alias("retyped"))
    every = schema_of.select(key).join(of_entities, key, "left").join(of_known, key, "left").join(of_relations, key, "left").join(twice, key, "left")
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    unknown = F.coalesce("given", F.lit(0)) - F.coalesce("known", F.lit(0))
    counts = every.select(key, unknown.alias("unknown_types"), *(number(c) for c in ("retyped", "dropped", "illegal", "repaired", "over_cap")), F.when(F.col("twice"), "duplicate entity ids").alias("error"))
    alive = fresh.join(twice.where("not twice"), key, "left_semi").select(*entities.columns)
    return Lenient(alive, out, counts)
