"""Queries over what several labellers say of the same documents: names put together, aliases, claims.

A nation is a document; suppliers and customers are what two labellers found in it, with names and mentions by md5 that they share here and there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import judging
from ..operators.rows import written
from .catalog import EDGES_SQL, H, query, structured_edges, table

SPREAD = 400


def labelled(spark, sf_dir) -> DataFrame:
    """doc_id, source, ord, name, type, mentions."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.lit("a").alias("source"), F.col("s_suppkey").alias("ord"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.lit("b").alias("source"), F.col("c_custkey").alias("ord"))
    h = judging.hashed(F.lit("l"), F.col("source"), F.col("ord"))
    d = s.unionByName(c).withColumn("h", h)
    n = lambda by, of: F.pmod(F.floor(F.col("h") / by), F.lit(of)).cast("string")
    name = F.when(F.pmod(F.col("h"), F.lit(9)) == 0, F.concat(F.lit("the firm "), n(9, 40))).otherwise(F.concat(F.lit("Firm "), n(9, SPREAD)))
    mentions = F.array(F.concat(F.lit("FIRM, "), n(4000, SPREAD)), F.concat(F.lit("the firm "), n(50, 40)), F.concat(F.lit("No. "), n(900, SPREAD)))
    kind = F.when(F.pmod(F.floor(F.col("h") / 77), F.lit(12)) == 0, "Place").otherwise("Org")
    return d.select("doc_id", "source", "ord", name.alias("name"), kind.alias("type"), mentions.alias("mentions"))


LABELLED_SQL = rf"""raw AS (SELECT s_nationkey AS doc_id, 'a' AS source, s_suppkey AS ord FROM supplier UNION ALL SELECT c_nationkey, 'b', c_custkey FROM customer), hashed AS (SELECT *, {H.format("'l|' || source || '|' || ord")} AS h FROM raw),
    ent AS (SELECT doc_id, source || lpad(ord::VARCHAR, 12, '0') AS eid, CASE WHEN h % 9 = 0 THEN 'the firm ' || (h // 9 % 40) ELSE 'Firm ' || (h // 9 % {SPREAD}) END AS name, CASE WHEN h // 77 % 12 = 0 THEN 'Place' ELSE 'Org' END AS type,
      ['FIRM, ' || (h // 4000 % {SPREAD}), 'the firm ' || (h // 50 % 40), 'No. ' || (h // 900 % {SPREAD})] AS mentions FROM hashed),
    n AS (SELECT doc_id, eid, name, type, unnest(list_prepend(name, mentions)) AS m, unnest(range(4)) AS p FROM ent),
    k AS MATERIALIZED (SELECT *, trim(regexp_replace(regexp_replace(lower(m), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS key, regexp_matches(m, '^[A-Z]') AS capital FROM n)"""


@query(
    "pool_aliases",
    f"""WITH RECURSIVE {LABELLED_SQL}, one AS (SELECT doc_id, key FROM k GROUP BY ALL HAVING count(DISTINCT type) = 1 AND key <> ''),
    u AS (SELECT k.* FROM k JOIN one USING (doc_id, key) WHERE capital OR m = name), hub AS (SELECT doc_id, eid, arg_min(key, p) AS hub FROM u GROUP BY ALL),
    e AS (SELECT DISTINCT doc_id, hub AS a, key AS b FROM u JOIN hub USING (doc_id, eid) WHERE key <> hub), ways AS MATERIALIZED (SELECT * FROM e UNION SELECT doc_id, b, a FROM e),
    r AS (SELECT doc_id, a AS name, a AS x FROM ways UNION SELECT r.doc_id, r.name, ways.b FROM r JOIN ways ON ways.doc_id = r.doc_id AND ways.a = r.x)
    SELECT doc_id, name, min(x) AS canonical FROM r GROUP BY doc_id, name""",
)
def pool_aliases(spark, sf_dir):
    """Names that labellers' entities tie together, and the least of each group."""
    return judging.labelled_aliases(labelled(spark, sf_dir), written)


@query(
    "pool_names",
    f"""WITH RECURSIVE {LABELLED_SQL}, own AS (SELECT doc_id, key, min(eid) AS owner FROM k WHERE capital OR m = name GROUP BY ALL),
    f AS MATERIALIZED (SELECT k.doc_id, eid, arg_min(owner, p) AS parent FROM k JOIN own USING (doc_id, key) WHERE owner < eid GROUP BY ALL),
    r AS (SELECT ent.doc_id, ent.eid, ent.eid AS top FROM ent UNION SELECT r.doc_id, r.eid, f.parent FROM r JOIN f ON f.doc_id = r.doc_id AND f.eid = r.top),
    root AS (SELECT doc_id, eid, min(top) AS top FROM r GROUP BY ALL), named AS (SELECT own.doc_id, own.key, ent.name AS root FROM own JOIN root ON root.doc_id = own.doc_id AND root.eid = owner JOIN ent ON ent.doc_id = own.doc_id AND ent.eid = root.top),
    mine AS (SELECT k.doc_id, k.eid, root FROM k JOIN named USING (doc_id, key) WHERE p = 0),
    low AS (SELECT k.doc_id, key, type, min(root) AS root FROM k JOIN mine USING (doc_id, eid) WHERE NOT capital AND m <> name GROUP BY ALL HAVING count(DISTINCT root) = 1),
    last AS (SELECT k.doc_id, k.key, arg_max(low.root, eid) AS root FROM k JOIN low ON low.doc_id = k.doc_id AND low.key = k.key AND low.type = k.type WHERE p = 0 AND NOT capital GROUP BY ALL)
    SELECT named.doc_id, named.key, coalesce(last.root, named.root) AS canonical FROM named LEFT JOIN last USING (doc_id, key)""",
)
def pool_names(spark, sf_dir):
    """The canonical name of each key, from the entities of both labellers in order."""
    return judging.canonical_names(labelled(spark, sf_dir), written)


@query(
    "world_decoys",
    f"""WITH {EDGES_SQL}, pool AS (SELECT DISTINCT tgt AS doc_id, src, type, tgt FROM edges WHERE type IN ('HEADQUARTERED_IN', 'OPERATES_IN')), named AS (SELECT DISTINCT doc_id, upper(src) AS src FROM pool WHERE src LIKE 's%'),
    world AS (SELECT 'S' || s_suppkey AS src, 'LOCATED_IN' AS type, 'r' || (s_nationkey % 5) AS tgt FROM supplier UNION SELECT 's' || s_suppkey, 'HEADQUARTERED_IN', 'n' || (s_nationkey // 2 * 2) FROM supplier)
    SELECT n.doc_id, w.src, w.type, w.tgt, 'world' AS kind FROM named n JOIN world w ON lower(w.src) = lower(n.src) WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.doc_id = n.doc_id AND p.src = w.src AND p.type = w.type AND p.tgt = w.tgt)
    AND {H.format("'world|' || n.doc_id || '|' || w.src || '|' || w.type || '|' || w.tgt")} % 2 = 0""",
)
def world_decoys(spark, sf_dir):
    """Facts about suppliers planted in the nations that name them, where these don't claim them."""
    edges = structured_edges(spark, sf_dir).where("type in ('HEADQUARTERED_IN', 'OPERATES_IN')")
    pool = edges.select(F.col("tgt").alias("doc_id"), "src", "type", "tgt").distinct()
    s = table(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit(c), F.col("s_suppkey").cast("string")).alias("src")
    place = lambda c, n: F.concat(F.lit(c), n.cast("string")).alias("tgt")
    world = s.select(name("S"), F.lit("LOCATED_IN").alias("type"), place("r", F.col("s_nationkey") % 5)).unionByName(s.select(name("s"), F.lit("HEADQUARTERED_IN").alias("type"), place("n", (F.floor(F.col("s_nationkey") / 2) * 2).cast("int"))))
    return judging.world_decoys(pool, pool.where("src like 's%'").select("doc_id", F.upper("src").alias("name")), world)
