"""Extraction against gold: aligned entities, sets that agree or don't, and precision, recall and F1.

Spans are (chunk_id, ent, type, start, end); relations (chunk_id, type, src, tgt). Missing predictions count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decoding import shown_name
from .islands import let


def f1_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 to four places; 0 where undefined."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(part(2 * p * r, p + r), 4).alias("f1")]


def compared(gold: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """Distinct rows of both, with in_gold and in_pred. Nulls equal each other, so several unaligned rows that read alike are one."""
    g = gold.select(*on).distinct().withColumn("in_gold", F.lit(1)).withColumn("in_pred", F.lit(0))
    p = pred.select(*on).distinct().withColumn("in_gold", F.lit(0)).withColumn("in_pred", F.lit(1))
    return g.unionByName(p).groupBy(*on).agg(F.max("in_gold").alias("in_gold"), F.max("in_pred").alias("in_pred"))


def counted(both: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """tp, fp, fn, and their shares, per group or in all. A row stands for as many as its weight says; one of neither side counts for nothing."""
    n = lambda c: (F.count_if(c) if weight is None else F.coalesce(F.sum(F.when(c, weight)), F.lit(0))).cast("long")
    out = both.groupBy(*(by or [])).agg(n(F.expr("in_gold = 1 and in_pred = 1")).alias("tp"), n(F.expr("in_gold = 0 and in_pred = 1")).alias("fp"), n(F.expr("in_pred = 0 and in_gold = 1")).alias("fn"))
    return out.select("*", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def aligned(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """chunk_id, pred_ent, gold_ent: of the same type's gold entities the one whose spans overlap a predicted entity's most, null if none do.

    A predicted span counts with its best overlap; equal sums go to the gold entity that is listed first (ord).
    """
    p = pred.select("chunk_id", "type", F.col("ent").alias("pred_ent"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    g = gold.select("chunk_id", "type", F.col("ent").alias("gold_ent"), "ord", F.col("start").alias("gs"), F.col("end").alias("ge"))
    met = p.join(g, (p.chunk_id == g.chunk_id) & (p.type == g.type) & (p.ps < g.ge) & (g.gs < p.pe)).select(p.chunk_id, "pred_ent", "gold_ent", "ord", "ps", "pe", (F.least("pe", "ge") - F.greatest("ps", "gs")).alias("overlap"))
    best = met.groupBy("chunk_id", "pred_ent", "gold_ent", "ord", "ps", "pe").agg(F.max("overlap").alias("overlap"))
    sums = best.groupBy("chunk_id", "pred_ent", "gold_ent", "ord").agg(F.sum("overlap").alias("overlap"))
    chosen = sums.groupBy("chunk_id", "pred_ent").agg(F.max_by("gold_ent", F.struct("overlap", -F.col("ord"))).alias("gold_ent"))
    return p.select("chunk_id", "pred_ent").distinct().join(chosen, ["chunk_id", "pred_ent"], "left")


def renamed(relations: DataFrame, alignment: DataFrame) -> DataFrame:
    """Predicted relations with gold entities as ends, null where there is none."""
    end = lambda k: alignment.select("chunk_id", F.col("pred_ent").alias(k), F.col("gold_ent").alias(f"{k}_gold"))
    r = relations.join(end("src"), ["chunk_id", "src"], "left").join(end("tgt"), ["chunk_id", "tgt"], "left")
    return r.select("chunk_id", "type", F.col("src_gold").alias("src"), F.col("tgt_gold").alias("tgt"))


def canonical(relations: DataFrame, symmetric: frozenset[str] | set[str]) -> DataFrame:
    swap = F.col("type").isin(*symmetric) & F.col("src").isNotNull() & F.col("tgt").isNotNull() & (F.col("tgt") < F.col("src")) if symmetric else F.lit(False)
    return relations.select("chunk_id", "type", F.when(swap, F.col("tgt")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("tgt")).alias("tgt"))


def spans_of(results: DataFrame) -> DataFrame:
    """chunk_id, ent, ord, type, start, end: where the entities of results (entities, spans by entity id) stand."""
    e = results.select("chunk_id", "spans", F.posexplode("entities").alias("ord", "e"))
    at = e.select("chunk_id", F.col("e.id").alias("ent"), "ord", F.col("e.type").alias("type"), F.explode(F.element_at("spans", F.col("e.id"))).alias("s"))
    return at.select("chunk_id", "ent", "ord", "type", "s.start", "s.end")


def labels_of(results: DataFrame) -> DataFrame:
    """chunk_id, ent, type, name: entities by what both sides can name, their best surface, in lower case without full stops."""
    from ..functions.names import display_name
    from .rows import flat_map

    def make(entities):
        for e in entities or []:
            yield e["id"], e["type"], " ".join(display_name(e["mentions"]).lower().replace(".", "").split())

    return flat_map(results, ["chunk_id"], ["entities"], make, "ent string, type string, name string")


def triples_of(results: DataFrame) -> DataFrame:
    """chunk_id, type, src, tgt by entity id."""
    return results.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", "r.type", F.col("r.source").alias("src"), F.col("r.target").alias("tgt"))


def relation_relaxed(gold: DataFrame, pred: DataFrame, gold_labels: DataFrame, pred_labels: DataFrame, symmetric: set[str]) -> DataFrame:
    """Relations whose ends agree by name and type, whatever the spans."""

    def by_name(relations: DataFrame, labels: DataFrame) -> DataFrame:
        end = lambda k: labels.select("chunk_id", F.col("ent").alias(k), F.concat_ws("|", "name", "type").alias(f"{k}_name"))
        r = relations.join(end("src"), ["chunk_id", "src"]).join(end("tgt"), ["chunk_id", "tgt"])
        return canonical(r.select("chunk_id", "type", F.col("src_name").alias("src"), F.col("tgt_name").alias("tgt")), symmetric)

    return counted(compared(by_name(gold, gold_labels), by_name(pred, pred_labels), ["chunk_id", "type", "src", "tgt"]))


def entity_strict(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return counted(compared(gold, pred, ["chunk_id", "start", "end", "type"]))


def entity_relaxed(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """By name (a column, normalised) and type."""
    return counted(compared(gold, pred, ["chunk_id", "name", "type"]))


def coreference_pairs(spans: DataFrame) -> DataFrame:
    """Unordered pairs of different spans of one entity."""
    one = lambda k: spans.select("chunk_id", "ent", F.struct("start", "end").alias(k)).distinct()
    return one("a").join(one("b"), ["chunk_id", "ent"]).where("a < b").select("chunk_id", "a", "b").distinct()


def coreference(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return counted(compared(coreference_pairs(gold), coreference_pairs(pred), ["chunk_id", "a", "b"]))


def relation_strict(gold: DataFrame, pred: DataFrame, alignment: DataFrame, symmetric: set[str], by_type: bool = False) -> DataFrame:
    both = compared(canonical(gold, symmetric), canonical(renamed(pred, alignment), symmetric), ["chunk_id", "type", "src", "tgt"])
    return counted(both, ["type"] if by_type else None)


def relation_pairs(gold: DataFrame, pred: DataFrame, alignment: DataFrame) -> DataFrame:
    """Found pairs, whatever the type: tp, fp, fn; and of the shared pairs how many have a type in common (typed, shared)."""
    pair = lambda df: df.select("chunk_id", "type", F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), (F.col("src").isNull() | F.col("tgt").isNull()).alias("open"))
    g = pair(gold).groupBy("chunk_id", "a", "b").agg(F.collect_set("type").alias("g"))
    p = pair(renamed(pred, alignment)).distinct()
    loose = p.where("open").agg(F.count("*").alias("loose"))
    tied = p.where("not open").groupBy("chunk_id", "a", "b").agg(F.collect_set("type").alias("p"))
    both = g.join(tied, ["chunk_id", "a", "b"], "full")
    n = lambda c: F.count_if(F.expr(c)).cast("long")
    counts = both.agg(n("g is not null and p is not null").alias("tp"), n("g is null").alias("fp"), n("p is null").alias("fn"), n("arrays_overlap(g, p)").alias("typed"))
    out = counts.crossJoin(F.broadcast(loose)).withColumn("fp", F.col("fp") + F.col("loose")).drop("loose").withColumn("shared", F.col("tp"))  # one row each
    return out.select("*", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def summary(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Health of the answers over all chunks: a chunk without a result counts as empty and invalid."""
    r = chunks.select("chunk_id").join(results, "chunk_id", "left")
    share = lambda a, b: F.round(F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0), 4)
    ok = F.col("error").isNull() & F.col("entities").isNotNull()
    mentions = F.coalesce(F.aggregate("entities", F.lit(0), lambda n, e: n + F.size(e["mentions"])), F.lit(0))
    relations = F.coalesce(F.size("relations"), F.lit(0))
    lost_m, lost_e = F.coalesce("unresolved_mentions", F.lit(0)), F.coalesce("unresolved_evidence", F.lit(0))
    illegal = F.coalesce("illegal_relations", F.lit(0))
    took = F.sum("seconds") if "seconds" in results.columns else F.lit(None).cast("double")
    return r.agg(
        F.count("*").alias("chunks"), F.round(F.avg(ok.cast("double")), 4).alias("schema_validity"), share(lost_m, mentions + lost_m).alias("hallucinated_mentions"),
        share(lost_e, relations + lost_e).alias("hallucinated_evidence"), share(illegal, relations + illegal).alias("illegal_relations"),
        F.round(F.when(took > 0, 60 * F.count("*") / took), 2).alias("chunks_per_minute"),
    )


def _entities(of: str) -> Column:
    """Entities of a column (entities, spans by id) with what they are compared by: their best surface in lower case without full stops, their type, their spans."""
    label = lambda e: F.trim(F.regexp_replace(F.translate(F.lower(shown_name(e["mentions"])), ".", ""), r"(?U)\s+", " "))
    at = lambda e: F.sort_array(F.array_distinct(F.coalesce(F.try_element_at(F.col(f"{of}.spans"), e["id"]), F.array().cast("array<struct<start: int, end: int>>"))))
    known = lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), F.concat_ws("\x01", label(e), e["type"]).alias("label"), at(e).alias("spans"))
    return F.transform(F.coalesce(F.col(f"{of}.entities"), F.array()), known)


def _alignment(pred: Column, gold: Column) -> Column:
    """id of each predicted entity -> the gold entity of its type that its spans overlap most; the first of equals, none without overlap."""

    def shared(p: Column, g: Column) -> Column:
        one = lambda s: F.aggregate(g["spans"], F.lit(0), lambda most, t: F.greatest(most, F.least(s["end"], t["end"]) - F.greatest(s["start"], t["start"])))
        return F.aggregate(p["spans"], F.lit(0), lambda n, s: n + one(s))

    def best(p: Column) -> Column:
        met = F.transform(F.filter(gold, lambda g: g["type"] == p["type"]), lambda g, i: F.struct(shared(p, g).alias("n"), (-i).alias("i"), g["id"].alias("id")))
        return let(F.array_max(met), lambda top: F.struct(p["id"].alias("id"), F.when(top["n"] > 0, top["id"]).alias("to")))

    return F.map_from_entries(F.transform(pred, best))


def _names(entities: Column) -> Column:
    """id -> label of the first entity that has it."""
    first = lambda e, i: ~F.exists(F.slice(entities, 1, i), lambda x: x["id"] == e["id"])
    return F.map_from_entries(F.transform(F.filter(entities, first), lambda e: F.struct(e["id"], e["label"])))


def _triples(of: str, end: Callable[[Column], Column], symmetric: Column) -> Column:
    """The distinct relations of a column by what `end` makes of their ends; those of a symmetric type in one order."""

    def triple(r: Column) -> Column:
        swap = F.coalesce(F.array_contains(symmetric, r["type"]) & (r["b"] < r["a"]), F.lit(False))
        return F.struct(r["type"].alias("type"), F.when(swap, r["b"]).otherwise(r["a"]).alias("a"), F.when(swap, r["a"]).otherwise(r["b"]).alias("b"))

    ended = F.transform(F.coalesce(F.col(f"{of}.relations"), F.array()), lambda r: F.struct(r["type"].alias("type"), end(r["source"]).alias("a"), end(r["target"]).alias("b")))
    return F.array_distinct(F.transform(ended, triple))


def _strict(entities: Column) -> Column:
    """The distinct spans with their types."""
    return F.array_distinct(F.flatten(F.transform(entities, lambda e: F.transform(e["spans"], lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), e["type"].alias("t"))))))


def _tied(entities: Column) -> Column:
    """The distinct pairs of spans of one entity, which are in order."""
    pairs = lambda x: F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.array_distinct(F.flatten(F.transform(entities, lambda e: pairs(e["spans"]))))


def _pairs(triples: Column) -> Column:
    """The distinct pairs of ends that are known, whatever the type."""
    tied = F.filter(triples, lambda t: t["a"].isNotNull() & t["b"].isNotNull())
    return F.array_distinct(F.transform(tied, lambda t: F.struct(F.least(t["a"], t["b"]).alias("a"), F.greatest(t["a"], t["b"]).alias("b"))))


def chunk_counts(gold: DataFrame, results: DataFrame, symmetric: dict[str, list[str]], sources: list[str] | None = None) -> DataFrame:
    """source, schema, chunk_id, metric, type, tp, fp, fn: what each chunk of gold adds to each metric, for each source of results.

    gold: chunk_id, schema, entities, relations, spans; results the same with source instead of schema. A chunk that a source doesn't answer, or
    answers with an error, counts as empty. rel_strict has a row for each type, others one of null type; rel_type counts the pairs
    that both sides relate as right (tp) or not (fp, fn). A chunk meets the results of all sources in one join by chunk_id, and what
    is compared of gold is made once a chunk. Where sources aren't named, results are read once more for them.
    """
    named = results.select("source").distinct() if sources is None else results.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in symmetric.items() for x in kv))
    sym = F.col("sym")

    def compared_by(df: DataFrame, of: str, end: Callable[[Column], Column]) -> DataFrame:
        """Adds what is compared of a side, each set made once: relations by what `end` makes of their ends, and by names."""
        e = F.col(f"{of}e")
        df = df.withColumn(f"{of}_name", _names(e)).withColumn(f"{of}_triples", _triples(of, end, sym))
        by_name = _triples(of, lambda x: F.try_element_at(f"{of}_name", x), sym)
        labels = F.array_distinct(F.transform(e, lambda x: x["label"]))
        return df.withColumns({f"{of}_ent_strict": _strict(e), f"{of}_ent_relaxed": labels, f"{of}_coref": _tied(e), f"{of}_rel_relaxed": by_name, f"{of}_rel_pair": _pairs(F.col(f"{of}_triples"))})

    sets = ["ent_strict", "ent_relaxed", "coref", "rel_relaxed", "rel_pair", "triples"]
    bundle = F.struct("entities", "relations", "spans")
    own = gold.select("chunk_id", "schema", bundle.alias("g")).withColumn("sym", F.coalesce(table[F.col("schema")], F.array().cast("array<string>"))).withColumn("ge", _entities("g"))
    own = compared_by(own, "g", lambda x: x).select("chunk_id", "schema", "sym", "ge", *(f"g_{k}" for k in sets))
    w = W.partitionBy("chunk_id").orderBy("source")  # collected by one sort, where an aggregation would sort twice
    said = results.withColumn("said", F.collect_list(F.struct("source", bundle.alias("p"))).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    said = said.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("chunk_id", "said")
    every = own.join(said, "chunk_id", "left").crossJoin(F.broadcast(named))  # a row for each system
    both = every.withColumn("p", F.explode_outer(F.filter("said", lambda x: x["source"] == F.col("source"))["p"])).drop("said").withColumn("pe", _entities("p"))
    both = compared_by(both.withColumn("to", _alignment(F.col("pe"), F.col("ge"))), "p", lambda x: F.try_element_at("to", x))
    both = both.select("source", "schema", "chunk_id", *(f"{of}_{k}" for of in "gp" for k in sets), *(F.array_intersect(f"g_{k}", f"p_{k}").alias(f"both_{k}") for k in sets))
    n = lambda x: F.size(x).cast("long")
    both = both.withColumn("right", n(_pairs(F.col("both_triples")))).withColumn("loose", n(F.filter("p_triples", lambda t: t["a"].isNull() | t["b"].isNull())))

    def row(metric: str, tp: Column, fp: Column, fn: Column, kind: Column | None = None) -> Column:
        return F.struct(F.lit(metric).alias("metric"), (F.lit(None).cast("string") if kind is None else kind).alias("type"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    def counts(metric: str, more: Column | None = None) -> Column:
        """Sets have each member once, so what one side has alone is its size less what both have."""
        tp = n(f"both_{metric}")
        fp = n(f"p_{metric}") - tp
        return row(metric, tp, fp if more is None else fp + more, n(f"g_{metric}") - tp)

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    by_type = lambda ts, *k: F.transform(ts, lambda t: row("rel_strict", *k, t["type"]))
    wrong = n("both_rel_pair") - F.col("right")
    fixed = F.array(
        *(counts(k) for k in ("ent_strict", "ent_relaxed", "coref", "rel_relaxed")),
        counts("rel_pair", F.col("loose")),
        row("rel_type", F.col("right"), wrong, wrong),
        row("rel_strict", zero, zero, zero),
    )
    strict = F.concat(
        by_type(F.col("both_triples"), one, zero, zero),
        by_type(F.array_except("p_triples", "g_triples"), zero, one, zero),
        by_type(F.array_except("g_triples", "p_triples"), zero, zero, one),
    )
    return both.select("source", "schema", "chunk_id", F.explode(F.concat(fixed, strict)).alias("m")).select("source", "schema", "chunk_id", "m.*")


def figures(gold: DataFrame, results: DataFrame, symmetric: dict[str, list[str]], by_type: bool = False, sources: list[str] | None = None) -> DataFrame:
    """source, schema, metric, type, tp, fp, fn, precision, recall, f1, as chunk_counts has them: one join and one aggregation, and grouping sets over its few sums.

    type is null for a metric as a whole; with by_type rel_strict has a row for each type as well.
    """
    on, sums = ["source", "schema", "metric", "type"], lambda: [F.sum(k).alias(k) for k in ("tp", "fp", "fn")]
    c = chunk_counts(gold, results, symmetric, sources).groupBy(*on).agg(*sums())
    sets = [["source", "schema", "metric"], *([["source", "schema", "metric", "type"]] if by_type else [])]
    whole = c.groupingSets([[F.col(x) for x in s] for s in sets], *on).agg(*sums(), F.grouping("type").alias("_whole"))
    return whole.where("_whole = 1 or type is not null").select(*on, "tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def summarized(gold: DataFrame, results: DataFrame, symmetric: set[str]) -> DataFrame:
    """metric, tp, fp, fn, precision, recall, f1, pooled over all chunks of gold; a chunk without a result counts as empty.

    Both tables have chunk_id, entities, relations and spans. The metrics are ent_strict, ent_relaxed, coref, rel_strict,
    rel_relaxed, rel_pair, and rel_type, whose tp are the found pairs that have a relation in common.
    """
    return figures(gold.withColumn("schema", F.lit("")), results.withColumn("source", F.lit("")), {"": sorted(symmetric)}).drop("source", "schema", "type")


def evaluated(gold: DataFrame, results: DataFrame, schemas: dict, union_results: DataFrame | None = None, by_type: bool = False) -> DataFrame:
    """source (generator, and union where given), schema, metric, type and figures: each chunk of gold (with a column schema) under its own schema."""
    columns = ["chunk_id", "entities", "relations", "spans"]
    rows = results.select(F.lit("generator").alias("source"), *columns)
    if union_results is not None:
        rows = rows.unionByName(union_results.select(F.lit("union").alias("source"), *columns))
    return figures(gold.where(F.col("schema").isin(*schemas)), rows, {k: sorted(s.symmetric()) for k, s in schemas.items()}, by_type)


def grid(written: DataFrame, scores: DataFrame, legal: DataFrame, gold: DataFrame, keys: list[str], cuts: list[float], margins: list[float], cap: int = 400) -> DataFrame:
    """cut, margin and the figures of the union with them, for each pair of settings (columns keys, type, src, tgt).

    The settings are a small table; each side of the union meets those that it depends on, and all are counted by one aggregation.
    """
    from .union import added, vetoed

    spark, on = written.sparkSession, [*keys, "type", "src", "tgt"]
    settings = spark.createDataFrame([(c, m) for c in cuts for m in margins], "cut double, margin_over double")
    meets = lambda df: df.crossJoin(F.broadcast(settings))  # noqa: E731  a row for each pair of settings
    tried = [*keys, "cut", "margin_over"]
    kept = vetoed(meets(written), scores, keys, F.col("cut"))
    more = added(kept, meets(scores), legal, tried, F.col("margin_over"), cap)
    found = kept.select(*tried, "type", "src", "tgt").unionByName(more.select(*tried, "type", "src", "tgt"))
    return counted(compared(meets(gold), found, ["cut", "margin_over", *on]), ["cut", "margin_over"]).withColumnRenamed("margin_over", "margin")


def sentence_distance(positions: DataFrame) -> DataFrame:
    """Least distance in sentences between any two entities of a chunk (chunk_id, ent, sentence)."""
    one = lambda k: positions.select("chunk_id", F.col("ent").alias(k), F.col("sentence").alias(f"{k}_s")).distinct()
    return one("a").join(one("b"), "chunk_id").where("a < b").groupBy("chunk_id", "a", "b").agg(F.min(F.abs(F.col("a_s") - F.col("b_s"))).alias("distance"))


def sweep(written: DataFrame, scores: DataFrame, gold: DataFrame, cuts: list[float]) -> DataFrame:
    """F1 of the written relations for each cut: cut, tp, fp, fn, precision, recall, f1 (columns chunk_id, type, src, tgt; scores with margin)."""
    on = ["chunk_id", "type", "src", "tgt"]
    tried = written.join(scores, on, "left").withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where(F.coalesce("margin", F.lit(-1e9)) > F.col("cut"))
    g = gold.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    return counted(compared(g, tried, ["cut", *on]), ["cut"])


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
