"""Queries that score predictions against gold, all metrics in one pass.

An order is a chunk, its lines are entities: what gold says of a line and what two systems say differs by md5, in spans, types and relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, judging
from .catalog import H, query, table

SYMMETRIC = ["O"]


def graphs(spark, sf_dir) -> DataFrame:
    """who (gold, one, two), chunk_id, entities, relations, spans as each sees orders. Lines are dealt out by their order once, for all three."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").repartition("chunk_id").distinct()
    of = [F.col("chunk_id"), F.col("l_partkey"), F.col("l_suppkey")]
    li = li.withColumn("base", judging.hashed(F.lit("gold"), *of)).withColumn("who", F.explode(F.array(*map(F.lit, ("gold", "one", "two")))))
    n = lambda by, of: F.pmod(F.floor(F.col("h") / by), F.lit(of))
    li = li.withColumn("h", F.when(F.col("who") == "gold", F.col("base")).otherwise(judging.hashed(F.col("who"), *of))).where(n(1, 9) != 0)
    start = F.pmod(F.col("base"), F.lit(60)) + F.when(n(9, 3) == 0, n(27, 4)).otherwise(0)
    span = lambda a: F.struct(a.cast("int").alias("start"), (a + 3).cast("int").alias("end"))
    spans = F.array(span(start), span(start + 10 + n(108, 2)))
    ident = F.concat(F.lit("e"), F.col("l_partkey").cast("string"), F.lit("x"), F.col("l_suppkey").cast("string"))
    kind = F.when(n(216, 8) == 0, "Z").otherwise(F.col("l_returnflag"))
    name = F.concat(F.lit("Part "), F.pmod(F.col("base"), F.lit(30)).cast("string"), F.when(n(1728, 6) == 0, " Ltd.").otherwise(""))
    entity = F.struct(ident.alias("id"), kind.alias("type"), F.array(name).alias("mentions"))
    w = evaluation.W.partitionBy("chunk_id", "who").orderBy("id")
    rows = li.select("who", "chunk_id", entity.alias("entity"), spans.alias("spans"), ident.alias("id"), F.when(n(10368, 5) == 0, "Q").otherwise(F.col("l_linestatus")).alias("type"), (n(51840, 4) == 0).alias("turned"))
    rows = rows.withColumn("next", F.lead("id").over(w))
    relation = F.when(F.col("next").isNotNull(), F.struct("type", F.when(F.col("turned"), F.col("next")).otherwise(F.col("id")).alias("source"), F.when(F.col("turned"), F.col("id")).otherwise(F.col("next")).alias("target")))
    every = lambda c: F.collect_list(c).over(w.rowsBetween(evaluation.W.unboundedPreceding, evaluation.W.unboundedFollowing))
    whole = rows.withColumns({"entities": every("entity"), "relations": every(relation), "at": every(F.struct("id", "spans")), "k": F.row_number().over(w)}).where("k = 1")
    return whole.select("who", "chunk_id", "entities", "relations", F.map_from_entries("at").alias("spans"))


def _side(who: str) -> str:
    h = H.format(f"'{who}|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey")
    g = H.format("'gold|' || l_orderkey || '|' || l_partkey || '|' || l_suppkey")
    return f"""h_{who} AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey, l_suppkey, l_returnflag, l_linestatus, {h} AS h, {g} AS base FROM lineitem WHERE {h} % 9 <> 0),
    e_{who} AS (SELECT chunk_id, 'e' || l_partkey || 'x' || l_suppkey AS id, CASE WHEN h // 216 % 8 = 0 THEN 'Z' ELSE l_returnflag END AS type, lower('Part ' || (base % 30) || CASE WHEN h // 1728 % 6 = 0 THEN ' Ltd' ELSE '' END) AS name,
      base % 60 + CASE WHEN h // 9 % 3 = 0 THEN h // 27 % 4 ELSE 0 END AS s1, s1 + 10 + h // 108 % 2 AS s2, CASE WHEN h // 10368 % 5 = 0 THEN 'Q' ELSE l_linestatus END AS rel, h // 51840 % 4 = 0 AS turned FROM h_{who}),
    s_{who} AS (SELECT chunk_id, id, type, unnest([s1, s2]) AS s FROM e_{who}), n_{who} AS (SELECT *, lead(id) OVER (PARTITION BY chunk_id ORDER BY id) AS next FROM e_{who}),
    r_{who} AS (SELECT chunk_id, rel AS type, CASE WHEN turned THEN next ELSE id END AS a, CASE WHEN turned THEN id ELSE next END AS b FROM n_{who} WHERE next IS NOT NULL)"""


def _system(who: str) -> str:
    """The counts of one system, for each metric."""
    swap = "CASE WHEN type = 'O' AND a IS NOT NULL AND b IS NOT NULL AND b < a THEN {} ELSE {} END"
    return f"""o_{who} AS (SELECT p.chunk_id, p.id, g.id AS gid, g.rank, p.s, max(least(p.s, g.s) + 3 - greatest(p.s, g.s)) AS n FROM s_{who} p JOIN (SELECT *, dense_rank() OVER (PARTITION BY chunk_id ORDER BY id) AS rank FROM s_gold) g ON g.chunk_id = p.chunk_id AND g.type = p.type AND p.s < g.s + 3 AND g.s < p.s + 3 GROUP BY ALL),
    a_{who} AS (SELECT chunk_id, id, arg_min(gid, (-n, rank)) AS gid FROM (SELECT chunk_id, id, gid, rank, sum(n) AS n FROM o_{who} GROUP BY ALL) GROUP BY ALL),
    m_{who} AS (SELECT r.chunk_id, r.type, {"r.a, r.b" if who == "gold" else "x.gid AS a, y.gid AS b"} FROM r_{who} r LEFT JOIN a_{who} x ON x.chunk_id = r.chunk_id AND x.id = r.a LEFT JOIN a_{who} y ON y.chunk_id = r.chunk_id AND y.id = r.b),
    t_{who} AS (SELECT DISTINCT chunk_id, type, {swap.format("b", "a")} AS a, {swap.format("a", "b")} AS b FROM m_{who} WHERE chunk_id IN (SELECT chunk_id FROM e_gold)),
    l_{who} AS (SELECT DISTINCT r.chunk_id, r.type, CASE WHEN r.type = 'O' THEN least(x.name || chr(1) || x.type, y.name || chr(1) || y.type) ELSE x.name || chr(1) || x.type END AS a, CASE WHEN r.type = 'O' THEN greatest(x.name || chr(1) || x.type, y.name || chr(1) || y.type) ELSE y.name || chr(1) || y.type END AS b
      FROM r_{who} r JOIN e_{who} x ON x.chunk_id = r.chunk_id AND x.id = r.a JOIN e_{who} y ON y.chunk_id = r.chunk_id AND y.id = r.b WHERE r.chunk_id IN (SELECT chunk_id FROM e_gold)),
    c_{who} AS (SELECT DISTINCT chunk_id, least(s1, s2) AS a, greatest(s1, s2) AS b FROM e_{who} WHERE chunk_id IN (SELECT chunk_id FROM e_gold)),
    q_{who} AS (SELECT DISTINCT chunk_id, least(a, b) AS a, greatest(a, b) AS b FROM t_{who} WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _counted(who: str, metric: str, of: str, columns: str, more: str = "0") -> str:
    own, gold = of.format(who), of.format("gold")
    return f"""SELECT '{who}' AS source, '{metric}' AS metric, NULL AS type, (SELECT count(*) FROM (SELECT {columns} FROM {own} INTERSECT SELECT {columns} FROM {gold})) AS tp, (SELECT count(*) FROM (SELECT {columns} FROM {own} EXCEPT SELECT {columns} FROM {gold})) + {more} AS fp, (SELECT count(*) FROM (SELECT {columns} FROM {gold} EXCEPT SELECT {columns} FROM {own})) AS fn"""


def _figures_sql() -> str:
    within = "(SELECT * FROM {} WHERE chunk_id IN (SELECT chunk_id FROM e_gold))"
    parts = []
    for who in ("one", "two"):
        parts += [
            _counted(who, "ent_strict", within.format("s_{}"), "chunk_id, s, type"),
            _counted(who, "ent_relaxed", within.format("e_{}"), "chunk_id, name, type"),
            _counted(who, "coref", "c_{}", "*"),
            _counted(who, "rel_relaxed", "l_{}", "*"),
            _counted(who, "rel_strict", "t_{}", "*"),
            _counted(who, "rel_pair", "q_{}", "*", f"(SELECT count(*) FROM t_{who} WHERE a IS NULL OR b IS NULL)"),
            f"""SELECT '{who}', 'rel_type', NULL, r, p - r, p - r FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT chunk_id, least(a, b), greatest(a, b) FROM (SELECT * FROM t_{who} INTERSECT SELECT * FROM t_gold))) AS r, (SELECT count(*) FROM (SELECT * FROM q_{who} INTERSECT SELECT * FROM q_gold)) AS p)""",
            f"""SELECT '{who}', 'rel_strict', type, count(*) FILTER (WHERE g AND p), count(*) FILTER (WHERE NOT g), count(*) FILTER (WHERE NOT p) FROM (SELECT type, bool_or(g) AS g, bool_or(NOT g) AS p FROM (SELECT *, true AS g FROM t_gold UNION ALL SELECT *, false FROM t_{who}) GROUP BY chunk_id, type, a, b) GROUP BY type""",
        ]
    f = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b}) ELSE 0.0::DOUBLE END"
    p, r = f("tp::DOUBLE", "tp + fp"), f("tp::DOUBLE", "tp + fn")
    return f"""WITH {_side("gold")}, {_side("one")}, {_side("two")}, {_system("gold")}, {_system("one")}, {_system("two")}, f AS ({" UNION ALL ".join(parts)}), g AS (SELECT *, {p} AS p, {r} AS r FROM f)
    SELECT source, metric, type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 4) AS "precision", round(r, 4) AS recall, round({f("2 * p * r", "p + r")}, 4) AS f1 FROM g"""


@query("evaluation_figures", _figures_sql())
def evaluation_figures(spark, sf_dir):
    """Seven metrics of two systems, and the strict relations of each type."""
    own = graphs(spark, sf_dir)
    systems = own.where("who != 'gold'").withColumnRenamed("who", "source")
    gold = own.where("who = 'gold'").drop("who").withColumn("schema", F.lit("s"))
    return evaluation.figures(gold, systems, {"s": SYMMETRIC}, by_type=True, sources=["one", "two"]).drop("schema")
