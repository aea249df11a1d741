"""Pooled judging: claims of several systems, decoys, verdicts, facts under aliases, scores with bootstrap intervals.

Claims are (doc_id, src, type, tgt) by name; claim_sources adds source. Draws are by hash, so every run and engine agrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import flat_map, ranked, small, written

CLAIM = ["doc_id", "src", "type", "tgt"]


def hashed(*parts: Column) -> Column:
    """The first 8 hexadecimal digits of an md5, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def key_of(name: Column) -> Column:
    """What names of claims are compared by, as functions.names.claim_key has it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def name_like(mention: Column) -> Column:
    """A mention that begins with a capital or a digit: "Smith", "4 July"; not "the court"."""
    return mention.rlike(r"^[\p{IsUppercase}\p{Nd}]")


def _mentioned(entities: DataFrame) -> DataFrame:
    """Entities (doc_id, source, ord, name, type, mentions) as a row for each of their names: doc_id, eid, type, name, p (0: the name itself), m, key."""
    said = F.concat(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>")))
    return entities.select("doc_id", F.struct("source", "ord").alias("eid"), "type", "name", F.posexplode(said).alias("p", "m")).withColumn("key", key_of(F.col("m")))


def canonical_names(entities: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = 40) -> DataFrame:
    """Entities (doc_id, source, ord, name, type, mentions) of all sources -> doc_id, key, canonical.

    Entities come in the order of source and ord. A key belongs to the first entity that has it as its name or as a capitalised mention. An
    entity follows the owner of the first of its keys that an earlier one owns, and takes its canonical name; one that follows none
    gives its own. So entities are a forest whose roots are found by pointers that double their reach each round (cut writes each
    round down). A name that begins with no capital then goes to the only owner that lists it as a mention, for entities of its type.
    """
    capital = F.col("m").rlike(r"^\p{IsUppercase}")
    names = cut(_mentioned(entities))
    owners = names.where(capital | (F.col("m") == F.col("name"))).groupBy("doc_id", "key").agg(F.min("eid").alias("owner"))
    earlier = names.join(owners, ["doc_id", "key"]).where(F.col("owner") < F.col("eid"))
    follows = earlier.groupBy("doc_id", "eid").agg(F.min_by("owner", "p").alias("to"))
    own = names.where("p = 0")
    now = cut(own.join(follows, ["doc_id", "eid"], "left").select("doc_id", "eid", F.coalesce("to", "eid").alias("to")))
    for _ in range(rounds):
        step = now.join(now.select("doc_id", F.col("eid").alias("to"), F.col("to").alias("further")), ["doc_id", "to"])
        moved = cut(step.select("doc_id", "eid", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moves")))
        now = moved.drop("moves")
        if not moved.where("moves").take(1):
            break
    roots = now.join(own.select("doc_id", F.col("eid").alias("to"), F.col("name").alias("root")), ["doc_id", "to"]).select("doc_id", "eid", "root")
    named = owners.join(roots.withColumnRenamed("eid", "owner"), ["doc_id", "owner"]).select("doc_id", "key", "root")
    of_own = own.join(named, ["doc_id", "key"]).select("doc_id", "eid", "root")  # every entity's name has an owner
    lower = names.where(~capital & (F.col("m") != F.col("name"))).join(of_own, ["doc_id", "eid"])
    only = lower.groupBy("doc_id", "key", "type").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a = b").select("doc_id", "key", F.col("type").alias("_type"), "a")
    plain = own.where(~capital)
    given = plain.join(only, (plain["doc_id"] == only["doc_id"]) & (plain["key"] == only["key"]) & plain["type"].eqNullSafe(only["_type"]))
    last = given.groupBy(plain["doc_id"], plain["key"]).agg(F.max_by("a", "eid").alias("changed"))
    return named.join(last, ["doc_id", "key"], "left").select("doc_id", "key", F.coalesce("changed", "root").alias("canonical"))


def labelled_aliases(entities: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Labellers' entities (doc_id, source, ord, name, type, mentions) -> doc_id, name (a key), canonical: names that one entity has.

    Only names that all labellers give one type count, and of mentions only those like names. An entity's names hang on the first of them;
    what hangs together, through all labellers, is a group, and its least name stands for it. Names alone in their group are left out.
    """
    names = cut(_mentioned(entities))
    told = F.coalesce(F.col("type"), F.lit("\x00"))
    single = names.groupBy("doc_id", "key").agg(F.min(told).alias("a"), F.max(told).alias("b")).where("a = b and key != ''").select("doc_id", "key")
    used = names.where((F.col("m") == F.col("name")) | name_like(F.col("m"))).join(single, ["doc_id", "key"], "left_semi")
    hubs = used.groupBy("doc_id", "eid").agg(F.min_by("key", "p").alias("hub"))
    node = lambda c: F.struct("doc_id", F.col(c).alias("name"))
    edges = used.join(hubs, ["doc_id", "eid"]).where("key != hub").select(node("hub").alias("a"), node("key").alias("b")).distinct()
    found = components(edges, cut)
    return found.select(F.col("node")["doc_id"].alias("doc_id"), F.col("node")["name"].alias("name"), F.col("least")["name"].alias("canonical"))


def pooled(claims: DataFrame) -> DataFrame:
    """Claims (doc_id, source, src, type, tgt) put together: sources in order, and n, a number within the document by hash."""
    p = claims.groupBy(*CLAIM).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    h = hashed(*(F.col(c) for c in CLAIM))
    return p.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy(h, "src", "type", "tgt")))


def world_decoys(pool: DataFrame, names: DataFrame, world: DataFrame) -> DataFrame:
    """Facts that are true in the world (src, type, tgt), planted in about half of the documents that name their source (names: doc_id, name)
    and don't claim them: doc_id, src, type, tgt, kind. Names meet by key; which half is by hash."""
    facts_ = world.select("src", "type", "tgt").distinct().withColumn("_key", key_of(F.col("src")))
    named = names.select("doc_id", key_of(F.col("name")).alias("_key")).distinct()
    met = named.join(facts_, "_key").select(*CLAIM).join(pool.select(*CLAIM), CLAIM, "left_anti")
    half = F.pmod(hashed(F.lit("world"), *(F.col(c) for c in CLAIM)), F.lit(2)) == 0
    return met.where(half).withColumn("kind", F.lit("world"))


def decoys(pool: DataFrame, symmetric: set[str], neighbours: DataFrame, names: DataFrame, per_doc: int = 2, swap: dict[str, str] | None = None, world: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = written, claimed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Claims made false on purpose (doc_id, src, type, tgt, kind): ends swapped, another target of its type, or another type.

    Of each document the per_doc claims that come first by hash are taken, each with the kind that its hash names; a decoy that is a
    pooled claim, or has nothing to change to, is left out. The other type is that of the swap table, else a neighbouring one. names:
    doc_id, name, type. With facts of the world (src, type, tgt) those are planted too, as world_decoys has it. The pool, a row
    for each claim, is read twice and not shuffled where the decoys are few. With claimed, which gives of some claims those that are pooled,
    the pool is read once and may leave out claims that are not among a document's first.
    """
    if claimed is not None and world is not None:
        raise ValueError("facts of the world meet the whole pool")
    h = hashed(F.lit("decoy"), *(F.col(c) for c in CLAIM))
    base = pool.withColumn("_h", h).withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("_h", "src", "type", "tgt"))).where(F.col("_n") <= per_doc)
    directed = ~F.col("type").isin(*symmetric) if symmetric else F.lit(True)
    kind = F.element_at(F.array(F.lit("direction"), F.lit("entity"), F.lit("type")), (F.pmod("_h", F.lit(3)) + 1).cast("int"))
    base = cut(base.withColumn("kind", F.when((kind == "direction") & ~directed, F.lit("entity")).otherwise(kind)).select(*CLAIM, "kind"))
    turned = base.where("kind = 'direction'").select("doc_id", F.col("tgt").alias("src"), "type", F.col("src").alias("tgt"), "kind")
    own = names.select("doc_id", F.col("name").alias("tgt"), F.col("type").alias("_t"))
    other = names.select("doc_id", F.col("name").alias("_new"), F.col("type").alias("_t"))
    swapped = small(cut(small(base).where("kind = 'entity'").join(own, ["doc_id", "tgt"]))).join(other, ["doc_id", "_t"]).where("_new != tgt and _new != src")
    swapped = swapped.groupBy("doc_id", "src", "type", "tgt", "kind").agg(F.min_by("_new", hashed(F.col("doc_id"), F.col("_new"))).alias("_new")).select("doc_id", "src", "type", F.col("_new").alias("tgt"), "kind")
    given = F.create_map(*(F.lit(x) for kv in swap.items() for x in kv))[F.col("type")] if swap else F.lit(None).cast("string")
    near = base.where("kind = 'type'").join(F.broadcast(neighbours), "type", "left").groupBy("doc_id", "src", "type", "tgt", "kind").agg(F.min("other").alias("other"))  # a schema's size
    typed = near.withColumn("type", F.coalesce(given, "other")).where("type is not null").select(*CLAIM, "kind")
    made = cut(turned.unionByName(swapped).unionByName(typed).groupBy(*CLAIM).agg(F.min("kind").alias("kind")))
    there = pool.select(*CLAIM).join(small(made.select(*CLAIM)), CLAIM, "left_semi") if claimed is None else claimed(made.select(*CLAIM))
    found = made.join(small(cut(there.distinct())), CLAIM, "left_anti")
    return found if world is None else found.unionByName(world_decoys(pool, names, world).join(found, CLAIM, "left_anti"))


def checked_verdicts(verdicts: DataFrame, docs: DataFrame, strict_quote: bool = True) -> DataFrame:
    """Verdicts (judge, doc_id, n, verdict, quote) with verdict true only if the quote is in the document's text, white space aside. An empty quote counts as none; strict_quote=False lets it pass."""
    flat = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ").alias("_text"))
    quote = F.trim(F.regexp_replace(F.coalesce("quote", F.lit("")), r"(?U)\s+", " "))
    there = F.col("_text").contains(quote) & ((quote != "") if strict_quote else F.lit(True))
    return verdicts.join(flat, "doc_id").withColumn("verdict", F.coalesce(F.col("verdict") & there, F.lit(False))).drop("_text")


def judged_true(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims (doc_id, n, …) with is_true: every judge says so. Without judges this is an error."""
    judges = verdicts.select("judge").distinct().agg(F.count("*").alias("_judges"))
    yes = verdicts.groupBy("doc_id", "n").agg(F.count_if("verdict").alias("_yes"))
    out = claims.join(yes, ["doc_id", "n"], "left").crossJoin(F.broadcast(judges))  # one row
    none = F.raise_error(F.lit("no judges")).cast("boolean")
    return out.withColumn("is_true", F.when(F.col("_judges") == 0, none).otherwise(F.coalesce(F.col("_yes") == F.col("_judges"), F.lit(False)))).drop("_yes", "_judges")


def decoy_check(decoy_claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judge, kind, decoys, accepted."""
    v = decoy_claims.join(verdicts, ["doc_id", "n"])
    return v.groupBy("judge", "kind").agg(F.count("*").alias("decoys"), F.count_if("verdict").alias("accepted"))


def disagreement(verdicts: DataFrame) -> DataFrame:
    """judge_a, judge_b, both, differ, over claims that both judged."""
    one = lambda k: verdicts.select("doc_id", "n", F.col("judge").alias(f"judge_{k}"), F.col("verdict").alias(k))
    both = one("a").join(one("b"), ["doc_id", "n"]).where("judge_a < judge_b")
    return both.groupBy("judge_a", "judge_b").agg(F.count("*").alias("both"), F.count_if(F.col("a") != F.col("b")).alias("differ"))


def alias_groups(pairs: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, name, canonical: names of a document that pairs (doc_id, a, b) tie together, and the least of them. Documents are as large as they like."""
    node = lambda c: F.struct("doc_id", F.col(c).alias("name"))
    found = components(pairs.where("a is not null and b is not null").select(node("a").alias("a"), node("b").alias("b")), cut)
    return found.select(F.col("node")["doc_id"].alias("doc_id"), F.col("node")["name"].alias("name"), F.col("least")["name"].alias("canonical"))


def components(edges: DataFrame, cut, rounds: int = 64) -> DataFrame:
    """node, least: connected components of edges (a, b) of any size, by least labels that also jump to their label's label; cut writes each round down."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("least")))
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("b"), F.col("least").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = now.join(near, "node").select("node", F.least("least", "l").alias("least"))
        jump = step.join(step.select(F.col("node").alias("least"), F.col("least").alias("l2")), "least").select("node", F.col("l2").alias("least"))
        new = cut(jump)
        if not new.join(now.withColumnRenamed("least", "old"), "node").where("least != old").take(1):
            return new
        now = new
    raise RuntimeError(f"no end after {rounds} rounds")


def facts(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims (doc_id, src, type, tgt, sources, is_true) by the keys of their names, or what aliases (doc_id, name, canonical) make of them: sources together, true if one of them is."""
    known = aliases.select("doc_id", key_of(F.col("name")).alias("_name"), key_of(F.col("canonical")).alias("_canonical")).distinct()
    end = lambda k: known.select("doc_id", F.col("_name").alias(k), F.col("_canonical").alias(f"_{k}"))
    c = claims.withColumn("src", key_of(F.col("src"))).withColumn("tgt", key_of(F.col("tgt")))
    c = c.join(end("src"), ["doc_id", "src"], "left").join(end("tgt"), ["doc_id", "tgt"], "left")
    c = c.withColumn("src", F.coalesce("_src", "src")).withColumn("tgt", F.coalesce("_tgt", "tgt"))
    return c.groupBy(*CLAIM).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.bool_or("is_true").alias("is_true"))


def per_document(fact_rows: DataFrame, sources: list[str]) -> DataFrame:
    """doc_id, source, true_facts (of all), wrote, right."""
    f = fact_rows.withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    has = F.array_contains("sources", F.col("source"))
    return f.groupBy("doc_id", "source").agg(F.count_if("is_true").alias("true_facts"), F.count_if(has).alias("wrote"), F.count_if(has & F.col("is_true")).alias("right"))


def scored(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, wrote, right, true_facts, precision, recall (of the pool) and f1."""
    s = counts.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in ("wrote", "right", "true_facts")))
    p, r = F.col("right") / F.greatest("wrote", F.lit(1)), F.col("right") / F.greatest("true_facts", F.lit(1))
    return s.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-9)), 6).alias("f1"))


def replicates(counts: DataFrame, rounds: int = 2000, salt: str = "boot") -> DataFrame:
    """replicate, source, f1: each replicate draws as many documents as there are, by hash, with replacement.

    The draws are counted per replicate and document first; documents are numbered in order of their hash, then id.
    """
    spark = counts.sparkSession
    docs = counts.select("doc_id").distinct()
    n = docs.count()
    if not n:
        return spark.createDataFrame([], "replicate long, source string, f1 double")
    numbered = ranked(docs, hashed(F.col("doc_id")), "doc_id").withColumn("slot", F.col("_rank") - 1)
    draws = spark.range(rounds * n).select(F.floor(F.col("id") / n).alias("replicate"), F.pmod("id", F.lit(n)).alias("k"))
    draws = draws.withColumn("slot", F.pmod(hashed(F.lit(salt), F.col("replicate"), F.col("k")), F.lit(n))).groupBy("replicate", "slot").agg(F.count("*").alias("times"))
    weighted = draws.join(numbered, "slot").join(counts, "doc_id")
    sums = weighted.groupBy("replicate", "source").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("wrote", "right", "true_facts")))
    p, r = F.col("right") / F.greatest("wrote", F.lit(1)), F.col("right") / F.greatest("true_facts", F.lit(1))
    return sums.select("replicate", "source", (2 * p * r / F.greatest(p + r, F.lit(1e-9))).alias("f1"))


def interval(values: DataFrame, by: list[str], value: str, rounds: int) -> DataFrame:
    """by, low, high: the sorted values at int(0.025 n) and int(0.975 n) - 1."""
    w = W.partitionBy(*by).orderBy(value) if by else W.orderBy(value)
    ranked = values.withColumn("_n", F.row_number().over(w) - 1)
    pick = lambda k: F.max(F.when(F.col("_n") == k, F.col(value)))
    return ranked.groupBy(*by).agg(F.round(pick(int(0.025 * rounds)), 6).alias("low"), F.round(pick(int(0.975 * rounds) - 1), 6).alias("high"))


def paired(counts: DataFrame, a: str, b: str, rounds: int = 4000) -> DataFrame:
    """difference of F1 and its interval, both systems under the same draws."""
    reps = replicates(counts.where(F.col("source").isin(a, b)), rounds, "pair")
    d = reps.groupBy("replicate").agg((F.max(F.when(F.col("source") == a, F.col("f1"))) - F.max(F.when(F.col("source") == b, F.col("f1")))).alias("d"))
    at = scored(counts, ["source"]).agg(F.round(F.max(F.when(F.col("source") == a, F.col("f1"))) - F.max(F.when(F.col("source") == b, F.col("f1"))), 6).alias("difference"))
    return at.crossJoin(F.broadcast(interval(d, [], "d", rounds)))  # one row each


def by_type(fact_rows: DataFrame, sources: list[str]) -> DataFrame:
    """source, scope, …: scores of each type with a true claim, of all (scope all), and without each of these types."""
    f = fact_rows.withColumn("source", F.explode(F.array(*map(F.lit, sources))))
    has = F.array_contains("sources", F.col("source"))
    per = f.groupBy("type", "source").agg(F.count_if("is_true").alias("true_facts"), F.count_if(has).alias("wrote"), F.count_if(has & F.col("is_true")).alias("right"))
    sums = [F.sum(c).alias(c) for c in ("true_facts", "wrote", "right")]
    each = per.where("true_facts > 0").withColumn("scope", F.col("type"))
    every = per.groupBy("source").agg(*sums).withColumn("scope", F.lit("all"))
    rest = each.select("source", F.concat(F.lit("without "), "type").alias("scope"), *(F.col(c).alias(f"_{c}") for c in ("true_facts", "wrote", "right"))).join(every.drop("scope"), "source")
    rest = rest.select("source", "scope", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in ("true_facts", "wrote", "right")))
    both = each.select("source", "scope", "true_facts", "wrote", "right").unionByName(every.select("source", "scope", "true_facts", "wrote", "right")).unionByName(rest)
    return scored(both, ["source", "scope"])


def with_source(pool: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """The pool (CLAIM, sources, n) with another system's claims: known ones gain the source, others get the next numbers of their document."""
    own = new.select(*CLAIM).distinct()
    mark = own.withColumn("_new", F.lit(True))
    known = pool.join(mark, CLAIM, "left").withColumn("sources", F.when(F.col("_new"), F.array_sort(F.array_union("sources", F.array(F.lit(source))))).otherwise(F.col("sources"))).drop("_new")
    last = pool.groupBy("doc_id").agg(F.max("n").alias("_last"))
    h = hashed(*(F.col(c) for c in CLAIM))
    more = own.join(pool, CLAIM, "left_anti").join(last, "doc_id", "left")
    more = more.withColumn("n", F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy("doc_id").orderBy(h, "src", "type", "tgt"))).withColumn("sources", F.array(F.lit(source)))
    return known.select(*CLAIM, "sources", "n").unionByName(more.select(*CLAIM, "sources", F.col("n").cast("int")))


def merged_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts of both; where both have one of a judge and claim, the earlier stays."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    rest = [c for c in old.columns if c not in ("judge", "doc_id", "n")]
    return both.groupBy("judge", "doc_id", "n").agg(*(F.min_by(c, "_o").alias(c) for c in rest))
