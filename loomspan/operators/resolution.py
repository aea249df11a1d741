"""Cross-chunk resolution: entity groups by a grouped map per document, or per block of a large one; everything after it with DataFrame operations.

Inputs are the tables of chunk graphs: entities (doc_id, chunk, ord, ent_id, type, name, attributes), mentions (doc_id, chunk,
ent_id, ord, mention, at) and relations (doc_id, chunk, ord, type, source, target, modality, attributes, score, origin,
sent_start, sent_end). Nodes are ordered by chunk, then listing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import generic, identifying, tokens
from ..functions.resolve import Entity, best_name, resolve
from .rows import flat_map, written


def _grouped(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row for each document with all its entities, in order of chunk and listing."""
    return _listed(entities, mentions).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("nodes"))


def _entities(nodes: list[dict]) -> list[Entity]:
    return [Entity(n["chunk"], n["ent_id"], n["type"], n["name"], [(m["mention"], m["at"]) for m in n["mentions"] or []]) for n in nodes]


#: Entities of a document from which on it is resolved block by block; the groups are the same.
LARGE = 5000
GROUPS = "chunk int, ent_id string, merged_id string, merged_name string, unnamed boolean"


def _shared(node: dict, carried: bool) -> list[tuple[str, bool]]:
    """What an entity may meet others by, and whether it asks: a surname asks for full names, a description for names and its like; equal ids, places and names meet anyway."""
    e = _entities([node])[0]
    out = [(f"0|{e.id}", True)] if carried else []
    out += [(f"a|{e.type}|{at}|{m.casefold()}", True) for m, at in e.mentions if at is not None and not generic(m)]
    for k in e.keys():
        out.append((f"b|{e.type}|{k}", True))
        words = k.split()
        out += [(f"s|{e.type}|{w}", len(words) == 1) for w in words]
    asks, kind = e.all_generic(), "" if carried else e.type  # equal ids may bring types together
    for d in e.descriptions():
        out.append((f"c|{e.type}|{d}", asks))
        out += [(f"h|{kind}|{d.split()[-1]}", True)] if asks else []
    out += [(f"h|{kind}|{w.casefold()}", False) for m in e.surfaces() if identifying(m) for w in tokens(m)]
    return sorted(set(out))


def blocks(entities: DataFrame, mentions: DataFrame, carried: bool, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, chunk, ent_id, block: entities of which no rule looks at one when it decides on another are in different blocks.

    Blocks are the components of entities and what they share, where one that shares it asks. Within a block, all of a rule's steps
    come in the order in which they come in the document, so that the groups are the document's.
    """
    from .judging import components

    keyed = _listed(entities, mentions)
    shared = cut(flat_map(keyed, ["doc_id", "chunk", "ord", "ent_id"], ["e"], lambda e: _shared(e, carried), "feature string, asks boolean"))
    node = F.struct("doc_id", "chunk", "ord", "ent_id")
    hubs = shared.groupBy("doc_id", "feature").agg(F.min(node).alias("hub"), F.bool_or("asks").alias("asked"), F.count(F.lit(1)).alias("n")).where("asked and n > 1")
    edges = shared.join(hubs, ["doc_id", "feature"]).select(F.col("hub").alias("a"), node.alias("b")).where("a != b").distinct()
    found = components(edges, cut).select(*(F.col("node")[c].alias(c) for c in ("doc_id", "chunk", "ent_id")), F.to_json("least").alias("block"))
    alone = F.concat_ws("|", F.col("chunk").cast("string"), "ent_id")
    return entities.select("doc_id", "chunk", "ent_id").join(found, ["doc_id", "chunk", "ent_id"], "left").withColumn("block", F.coalesce("block", alone))


def _listed(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, chunk, ord, ent_id and e, all that resolution asks of an entity."""
    m = mentions.groupBy("doc_id", "chunk", "ent_id").agg(F.array_sort(F.collect_list(F.struct("ord", "at", "mention"))).alias("mentions"))
    e = entities.join(m, ["doc_id", "chunk", "ent_id"], "left")
    return e.select("doc_id", "chunk", "ord", "ent_id", F.struct("chunk", "ord", "ent_id", "type", "name", "mentions").alias("e"))


def entity_groups(entities: DataFrame, mentions: DataFrame, carried: bool = False, carry_forward: bool = True, same_chunk: bool = False, large: int = LARGE, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """doc_id, chunk, ent_id, merged_id (e1, e2, … by first member), name of the group, unnamed (every mention and name is a pronoun or description).

    The entities of a document that has more than `large` are taken apart into blocks first, and a block is one task's work instead of the document.
    """

    def groups_of(nodes):
        """Each member of each group, with the group's first member."""
        own = _entities(nodes)
        groups = resolve(own, carried, carry_forward, same_chunk)
        by_node, place = {e.node: e for e in own}, {e.node: k for k, e in enumerate(own)}
        for members in groups.held.values():
            order = sorted(members, key=place.__getitem__)
            names = [by_node[n].name for n in order]
            unnamed = all(generic(s) for n in order for s in [by_node[n].name, *by_node[n].surfaces()])
            yield from ((n, place[order[0]], best_name(names), unnamed) for n in order)

    def of_document(nodes):
        made = list(groups_of(nodes))
        number = {first: k for k, first in enumerate(sorted({first for _, first, _, _ in made}), 1)}
        yield from ((*n, f"e{number[first]}", name, unnamed) for n, first, name, unnamed in made)

    def of_block(nodes):
        yield from ((*n, nodes[first]["chunk"], nodes[first]["ord"], nodes[first]["ent_id"], name, unnamed) for n, first, name, unnamed in groups_of(nodes))

    sizes = entities.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select("doc_id")
    if not sizes.take(1):
        return flat_map(_grouped(entities, mentions), ["doc_id"], ["nodes"], of_document, GROUPS)
    big = cut(sizes)
    some = lambda df, how: df.join(big, "doc_id", how)
    small = flat_map(_grouped(some(entities, "left_anti"), some(mentions, "left_anti")), ["doc_id"], ["nodes"], of_document, GROUPS)
    e, m = some(entities, "left_semi"), some(mentions, "left_semi")
    parts = _listed(e, m).join(blocks(e, m, carried, cut), ["doc_id", "chunk", "ent_id"]).groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("e")).alias("nodes"))
    made = flat_map(parts, ["doc_id"], ["nodes"], of_block, "chunk int, ent_id string, _chunk int, _ord int, _ent string, merged_name string, unnamed boolean")
    number = F.dense_rank().over(W.partitionBy("doc_id").orderBy("_chunk", "_ord", "_ent"))  # a document's groups by their first members
    numbered = made.withColumn("merged_id", F.concat(F.lit("e"), number.cast("string")))
    return small.unionByName(numbered.select("doc_id", "chunk", "ent_id", "merged_id", "merged_name", "unnamed"))


def union_log(entities: DataFrame, mentions: DataFrame, carried: bool = False) -> DataFrame:
    """doc_id, k, rule and the two nodes of every union, in the order in which they were made."""

    def make(nodes):
        for k, (rule, a, b) in enumerate(resolve(_entities(nodes), carried).log):
            yield k, rule, a[0], a[1], b[0], b[1]

    return flat_map(_grouped(entities, mentions), ["doc_id"], ["nodes"], make, "k int, rule string, chunk_a int, ent_a string, chunk_b int, ent_b string")


def occurrences(mentions: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, merged_id, mention, start, end, chunk: located mentions that the text bears out, each once."""
    m = mentions.where("at is not null").join(groups, ["doc_id", "chunk", "ent_id"]).join(docs.select("doc_id", "text"), "doc_id")
    there = m.where(F.expr("substring(text, at + 1, char_length(mention)) = mention"))
    first = there.groupBy("doc_id", "merged_id", "mention", F.col("at").alias("start")).agg(F.min("chunk").alias("chunk"))
    return first.withColumn("end", F.col("start") + F.char_length("mention"))


def merged_map(df: DataFrame, keys: list[str], order: Column, column: str = "attributes") -> DataFrame:
    """The maps of a group put together: of equal keys the first in order wins."""
    pairs = df.select(*keys, order.alias("_o"), F.explode(column).alias("_k", "_v"))
    first = pairs.groupBy(*keys, "_k").agg(F.min_by("_v", "_o").alias("_v"))
    return first.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(column))


def document_entities(entities: DataFrame, mentions: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, ent_id, type, name, attributes, chunks, aliases (surfaces without a place, as first seen), unnamed."""
    order = F.struct("chunk", "ord")
    e = entities.join(groups, ["doc_id", "chunk", "ent_id"])
    base = e.groupBy("doc_id", "merged_id").agg(F.min_by("type", order).alias("type"), F.first("merged_name").alias("name"), F.array_sort(F.collect_set("chunk")).alias("chunks"), F.first("unnamed").alias("unnamed"))
    located = found.select("doc_id", "merged_id", "mention").distinct()
    rest = mentions.join(groups, ["doc_id", "chunk", "ent_id"]).join(located, ["doc_id", "merged_id", "mention"], "left_anti")
    rest = rest.groupBy("doc_id", "merged_id", "mention").agg(F.min(order).alias("o")).groupBy("doc_id", "merged_id")
    aliases = rest.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "mention"))), lambda x: x["mention"]).alias("aliases"))
    more = merged_map(e, ["doc_id", "merged_id"], order)
    out = base.join(more, ["doc_id", "merged_id"], "left").join(aliases, ["doc_id", "merged_id"], "left")
    return out.withColumnRenamed("merged_id", "ent_id").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def rewritten(relations: DataFrame, groups: DataFrame, symmetric: frozenset[str], drop_unnamed: bool = True) -> DataFrame:
    """doc_id, type, source, target, modality, score, origin, chunks, ord: chunk relations between merged entities.

    Loops go, and those of entities that nothing names. Equal triples (of symmetric types in either direction) are one: the
    first gives direction and modality, the score is the highest, and the generator wrote it if it wrote any of them.
    """
    g = groups.select("doc_id", "chunk", "ent_id", "merged_id", "unnamed")
    end = lambda k: g.select("doc_id", "chunk", F.col("ent_id").alias(k), F.col("merged_id").alias(f"{k}_id"), F.col("unnamed").alias(f"{k}_unnamed"))
    r = relations.join(end("source"), ["doc_id", "chunk", "source"]).join(end("target"), ["doc_id", "chunk", "target"]).where("source_id != target_id")
    if drop_unnamed:
        r = r.where("not source_unnamed and not target_unnamed")
    swap = F.col("type").isin(*symmetric) & (F.col("target_id") < F.col("source_id")) if symmetric else F.lit(False)
    r = r.withColumn("_a", F.when(swap, F.col("target_id")).otherwise(F.col("source_id"))).withColumn("_b", F.when(swap, F.col("source_id")).otherwise(F.col("target_id")))
    order = F.struct("chunk", "ord")
    first = F.min_by(F.struct("source_id", "target_id", "modality"), order)
    out = r.groupBy("doc_id", "type", "_a", "_b").agg(first.alias("f"), F.max("score").alias("score"), F.bool_or(F.col("origin") == "generator").alias("written"), F.min_by("origin", order).alias("first_origin"), F.array_sort(F.collect_set("chunk")).alias("chunks"), F.min(order).alias("ord"))
    return out.select("doc_id", "type", F.col("f.source_id").alias("source"), F.col("f.target_id").alias("target"), F.col("f.modality").alias("modality"), "score", F.when(F.col("written"), "generator").otherwise(F.col("first_origin")).alias("origin"), "chunks", "ord")


def evidence(relations: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, type, source, target, chunk, sent_start, sent_end: the first evidence in each chunk, ends as merged and unordered."""
    g = groups.select("doc_id", "chunk", "ent_id", "merged_id")
    r = relations.join(g.withColumnRenamed("ent_id", "source").withColumnRenamed("merged_id", "s"), ["doc_id", "chunk", "source"]).join(g.withColumnRenamed("ent_id", "target").withColumnRenamed("merged_id", "t"), ["doc_id", "chunk", "target"]).where("s != t")
    first = F.min_by(F.struct("sent_start", "sent_end"), "ord").alias("f")
    return r.groupBy("doc_id", "type", F.least("s", "t").alias("source"), F.greatest("s", "t").alias("target"), "chunk").agg(first).select("doc_id", "type", "source", "target", "chunk", "f.*")


def shared_sentence(found: DataFrame, sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (doc_id, source, target, lo, hi, and what else names them) without evidence: the first sentence within lo and hi where both are mentioned."""
    from .segmentation import with_sentence

    m = with_sentence(found.select("doc_id", "merged_id", "start"), sentences, ["doc_id"]).where("sent_start is not null").select("doc_id", "merged_id", "sent_start", "sent_end").distinct()
    a, b = (m.select("doc_id", F.col("merged_id").alias(k), "sent_start", "sent_end") for k in ("source", "target"))
    both = pairs.join(a, ["doc_id", "source"]).join(b, ["doc_id", "target", "sent_start", "sent_end"]).where("sent_start >= lo and sent_end <= hi")
    named = [c for c in pairs.columns if c not in ("lo", "hi")]
    return both.groupBy(*named).agg(F.min(F.struct("sent_start", "sent_end")).alias("s")).select(*named, "s.*")


def surname_links(names: DataFrame) -> DataFrame:
    """Names (doc_id, type, key) of one word with the only longer name of the type that holds it: doc_id, type, key, full."""
    n = names.select("doc_id", "type", "key").distinct()
    words = n.where(F.col("key").contains(" ")).select("doc_id", "type", F.col("key").alias("full"), F.explode(F.array_distinct(F.split("key", " "))).alias("key"))
    one = words.groupBy("doc_id", "type", "key").agg(F.count_distinct("full").alias("n"), F.min("full").alias("full")).where("n = 1").drop("n")
    return n.where(~F.col("key").contains(" ")).join(one, ["doc_id", "type", "key"])


def nearest_earlier(entities: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Entities (keys, chunk) with the one candidate (keys, chunk, cand) in the nearest chunk at or before theirs; none where that chunk has several."""
    per = candidates.groupBy(*keys, "chunk").agg(F.count_distinct("cand").alias("n"), F.min("cand").alias("cand"))
    w = W.partitionBy(*keys).orderBy("chunk", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = per.select(*keys, "chunk", F.struct("n", "cand").alias("_c"), F.lit(0).alias("_kind")).unionByName(entities.select(*keys, "chunk", F.struct(*entities.columns).alias("_row"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    seen = both.withColumn("_c", F.last("_c", ignorenulls=True).over(w)).where("_kind = 1")
    return seen.select("_row.*", F.when(F.col("_c")["n"] == 1, F.col("_c")["cand"]).alias("cand"))
