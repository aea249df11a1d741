"""Document graphs: JSON Graph Format and GraphML out, JSON Graph Format in, and node and edge tables."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import flat_map

NODE = "struct<label: string, metadata: map<string, string>>"
EDGE = "struct<id: string, source: string, target: string, relation: string, directed: boolean, label: string, metadata: map<string, string>>"
GRAPH = f"struct<graph: struct<id: string, label: string, directed: boolean, type: string, metadata: map<string, string>, nodes: map<string, {NODE}>, edges: array<{EDGE}>>>"


def nodes_and_edges(entities: DataFrame, relations: DataFrame, mentions: DataFrame, symmetric: set[str]) -> tuple[DataFrame, DataFrame]:
    """nodes(doc_id, id, kind, label, metadata) and edges(doc_id, id, src, dst, relation, directed, metadata): entities, the document, relations r0, r1, … and mentions m0, m1, …"""
    from pyspark.sql import Window as W

    text = lambda c: F.to_json(c)
    meta = F.create_map(F.lit("kind"), F.lit("entity"), F.lit("type"), "type", F.lit("attributes"), text(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), F.lit("aliases"), text("aliases"), F.lit("chunks"), text("chunks"))
    nodes = entities.select("doc_id", F.col("ent_id").alias("id"), F.lit("entity").alias("kind"), F.col("name").alias("label"), meta.alias("metadata"))
    doc = entities.select("doc_id").distinct().select("doc_id", F.lit("document").alias("id"), F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("label"), F.create_map(F.lit("kind"), F.lit("document")).alias("metadata"))
    w = W.partitionBy("doc_id")
    directed = ~F.col("type").isin(*symmetric) if symmetric else F.lit(True)
    number = F.row_number().over(w.orderBy("ord", "type", "source", "target")) - 1
    rmeta = F.create_map(F.lit("kind"), F.lit("relation"), F.lit("modality"), "modality", F.lit("score"), F.col("score").cast("string"), F.lit("origin"), "origin", F.lit("chunks"), text("chunks"))
    rel = relations.select("doc_id", F.concat(F.lit("r"), number).alias("id"), F.col("source").alias("src"), F.col("target").alias("dst"), F.col("type").alias("relation"), directed.alias("directed"), rmeta.alias("metadata"))
    at = F.row_number().over(w.orderBy("start", "end", "merged_id", "mention")) - 1
    mmeta = F.create_map(F.lit("kind"), F.lit("mention"), F.lit("text"), "mention", F.lit("start"), F.col("start").cast("string"), F.lit("end"), F.col("end").cast("string"))
    men = mentions.select("doc_id", F.concat(F.lit("m"), at).alias("id"), F.col("merged_id").alias("src"), F.lit("document").alias("dst"), F.lit("MENTIONED_IN").alias("relation"), F.lit(True).alias("directed"), mmeta.alias("metadata"))
    return nodes.unionByName(doc), rel.unionByName(men)


def json_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id and its graph as one JSON object."""
    listed = F.array_sort(F.collect_list(F.struct("id", "label", F.to_json("metadata").alias("m"))))
    entry = lambda x: F.struct(x["id"], F.struct(x["label"].alias("label"), F.from_json(x["m"], "map<string,string>").alias("metadata")))
    n = nodes.groupBy("doc_id").agg(F.map_from_entries(F.transform(listed, entry)).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "src", "dst", "relation", "directed", F.to_json("metadata").alias("m")))), lambda x: F.struct(x["id"].alias("id"), x["src"].alias("source"), x["dst"].alias("target"), x["relation"].alias("relation"), x["directed"].alias("directed"), x["relation"].alias("label"), F.from_json(x["m"], "map<string,string>").alias("metadata"))).alias("edges"))
    g = n.join(e, "doc_id", "left")
    name = F.col("doc_id").cast("string")
    graph = F.struct(name.alias("id"), name.alias("label"), F.lit(True).alias("directed"), F.lit("knowledge graph").alias("type"), F.create_map(F.lit("version"), F.lit("2")).alias("metadata"), "nodes", F.coalesce("edges", F.array().cast(f"array<{EDGE}>")).alias("edges"))
    return g.select("doc_id", F.to_json(F.struct(graph.alias("graph"))).alias("value"))


def read_json_graphs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inverse, from a column value: entity nodes and relation edges, by metadata.kind."""
    g = lines.select(F.from_json("value", GRAPH)["graph"].alias("g"))
    nodes = g.select(F.col("g.id").alias("doc_id"), F.explode("g.nodes").alias("id", "n")).where("n.metadata['kind'] = 'entity'").select("doc_id", "id", "n.label", "n.metadata")
    edges = g.select(F.col("g.id").alias("doc_id"), F.explode("g.edges").alias("e")).where("e.metadata['kind'] = 'relation'").select("doc_id", "e.id", "e.source", "e.target", "e.relation", "e.directed", "e.metadata")
    return nodes, edges


# The keys that graphs, nodes and edges may have.
KEYS = {"graph": ["directed", "edges", "id", "label", "metadata", "nodes", "type"], "node": ["label", "metadata"], "edge": ["directed", "id", "label", "metadata", "relation", "source", "target"]}


def graph_errors(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and what is wrong with its graph (a column value): an empty list means that it is valid.

    Keys that a graph, a node or an edge may not have, and edges whose ends are no nodes. The value is read as a VARIANT, whatever its keys
    are, and checked in its row. Text that is no JSON, or says a key twice, has no graph object.
    """
    members = lambda v: F.try_variant_get(v, "$", "map<string, variant>")
    strange = lambda m, kind: F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*KEYS[kind])))
    none = F.array().cast("array<string>")
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$", "array<variant>")  # a list, so that nothing may follow the object
    read = lines.select(key, F.try_variant_get(F.when(F.size(one) == 1, one[0]), "$.graph", "map<string, variant>").alias("g"))
    read = read.select(key, "g", members(F.col("g")["nodes"]).alias("n"), F.try_variant_get(F.col("g")["edges"], "$", "array<variant>").alias("e"))
    has = lambda k: F.map_contains_key("g", F.lit(k))
    unfit = has("nodes") & F.col("n").isNull() | has("edges") & F.col("e").isNull()
    nodes = F.coalesce("n", F.create_map().cast("map<string, variant>"))
    own = F.transform(strange(F.col("g"), "graph"), lambda k: F.concat(F.lit("graph."), k))
    of_node = lambda x: F.transform(F.coalesce(strange(members(x["value"]), "node"), F.array(F.lit("no object"))), lambda k: F.concat(F.lit("node "), x["key"], F.lit("."), k))

    def of_edge(v):
        m, name = members(v), F.concat(F.lit("edge "), F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit("None")))
        odd = F.transform(F.coalesce(strange(m, "edge"), F.array(F.lit("no object"))), lambda k: F.concat(name, F.lit("."), k))
        end = lambda k: F.try_variant_get(v, f"$.{k}", "string")
        lost = F.filter(F.array(*(F.when(F.coalesce(~F.map_contains_key(nodes, end(k)), F.lit(True)), F.concat(name, F.lit(": no node "), F.coalesce(end(k), F.lit("None")))) for k in ("source", "target"))), lambda x: x.isNotNull())
        return F.concat(odd, F.when(m.isNotNull(), lost).otherwise(none))

    found = F.concat(own, F.flatten(F.transform(F.map_entries(nodes), of_node)), F.flatten(F.transform(F.coalesce("e", F.array().cast("array<variant>")), of_edge)))
    said = F.when(F.col("g").isNull(), F.array(F.lit("no graph object"))).when(unfit, F.concat(own, F.array(F.lit("nodes is no object or edges no array")))).otherwise(found)
    return read.select(key, said.alias("errors"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id and its graph as GraphML; attributes are strings, null ones are left out."""
    n = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", F.to_json("metadata").alias("m")))).alias("nodes"))
    e = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "src", "dst", "relation", "directed", F.to_json("metadata").alias("m")))).alias("edges"))

    def data(values: dict) -> str:
        return "".join(f"<data key={quoteattr(k)}>{escape(str(v))}</data>" for k, v in sorted(values.items()) if v is not None)

    def make(ns, es):
        ns = [(x["id"], {"label": x["label"]} | json.loads(x["m"])) for x in ns]
        es = [(x, {"relation": x["relation"]} | json.loads(x["m"])) for x in es or []]
        keys = [("node", sorted({k for _, d in ns for k in d})), ("edge", sorted({k for _, d in es for k in d}))]
        head = "".join(f'<key id={quoteattr(k)} for="{kind}" attr.name={quoteattr(k)} attr.type="string"/>' for kind, ks in keys for k in ks)
        body = "".join(f"<node id={quoteattr(i)}>{data(d)}</node>" for i, d in ns)
        body += "".join(f"<edge id={quoteattr(x['id'])} source={quoteattr(x['src'])} target={quoteattr(x['dst'])}>{data(d)}</edge>" for x, d in es)
        yield (f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{head}<graph edgedefault="directed">{body}</graph></graphml>',)

    return flat_map(n.join(e, "doc_id", "left"), ["doc_id"], ["nodes", "edges"], make, "value string")
