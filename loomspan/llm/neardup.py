"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, in bands, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small, table, whole
from .shingles import mixed, shingles

WORDS, SIMILAR = 5, 0.8
#: BANDS keys of ROWS samples each: texts of similarity 0.8 share one with probability 0.9998.
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Document frequencies are counted in so many hashed counters, which come to the driver and go to all executors whatever the input.
COUNTERS, SLICE = 1 << 20, 1 << 14
#: Steps that the inverse document frequency is rounded to, between 1/2 and 1.
LEVELS = 16
#: Rows of the tables of random variables.
RANDOM = 1 << 12
#: Two texts are similar only if they share this times the sum of their weights; so many rounds let the members of a bucket meet one of them.
SHARED, ROUNDS = SIMILAR / (1 + SIMILAR), 1
TEXTS = 200


# --- weights ---


def counter(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(44)).astype(np.int64)  # 20 bits


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(COUNTERS, np.int64), 0
    for batch in batches:
        for k in range(0, batch.num_rows, 5 * TEXTS):
            own = shingles(batch.column(0).slice(k, 5 * TEXTS).to_pylist(), WORDS)
            total += np.bincount(np.concatenate([counter(s) for s, _ in own]), minlength=COUNTERS)
            n += sum(len(s) > 0 for s, _ in own)
    for k in range(0, COUNTERS if n else 0, SLICE):
        counts = total[k : k + SLICE].astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n if not k else 0]), pa.array([counts])], names=["slice", "n", "counts"])


def _sum(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, at = np.zeros(SLICE, np.int64), 0, 0
    for batch in groups:
        for k in range(batch.num_rows):
            at, n = batch.column(0)[k].as_py(), n + batch.column(1)[k].as_py()
            total += np.frombuffer(batch.column(2)[k].as_py(), "<u4")
    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n]), pa.array([total.astype("<i8").tobytes()])], names=["slice", "n", "counts"])


def idf_levels(counts: np.ndarray, n: int) -> np.ndarray:
    """For each counter, LEVELS * ln(n / df) / ln n, rounded: LEVELS for a shingle of one text, 0 for one of all n.

    df is what the counter holds beyond the median of all counters, which is what other shingles have put there.
    """
    df = np.clip(counts - np.median(counts), 1, max(n, 1))
    return np.rint(LEVELS * np.log(max(n, 1) / df) / np.log(max(n, 2))).astype(np.uint8) if n > 1 else np.full(len(counts), LEVELS, np.uint8)


def frequencies(docs: DataFrame) -> np.ndarray:
    """The levels of all counters, over all texts."""
    texts = docs.select(whole().alias("text"))
    parts = texts.mapInArrow(_count, "slice long, n long, counts binary").groupBy("slice").applyInArrow(_sum, "slice long, n long, counts binary")
    counts, n = np.zeros(COUNTERS, np.int64), 0
    for r in parts.collect():  # COUNTERS / SLICE rows
        counts[r["slice"] : r["slice"] + SLICE], n = np.frombuffer(r["counts"], "<i8"), n + r["n"]
    return idf_levels(counts, n)


def weigh(own: tuple[np.ndarray, np.ndarray], levels: np.ndarray) -> np.ndarray:
    """Term frequency times inverse document frequency of each of a text's shingles; the latter is (1 + ln(n / df) / ln n) / 2."""
    return own[1] * (0.5 + levels[counter(own[0])] / (2.0 * LEVELS))


def similarity(a, b, levels) -> float:
    """Weighted Jaccard: the sum of the lesser weights over the sum of the greater ones."""
    wa, wb = weigh(a, levels), weigh(b, levels)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    rest = wa.sum() + wb.sum() - both
    return float(both / rest) if rest else 0.0


# --- samples ---


@cache
def _random() -> tuple[np.ndarray, ...]:
    """r and beta of a shingle come from one row, ln c from another: gamma(2, 1), uniform, and the logarithm of gamma(2, 1). The
    last table has r (t - beta + 1) for each level and row, for shingles that occur once in a text."""
    rng = np.random.default_rng(5)
    r = rng.gamma(2.0, 1.0, (RANDOM, SAMPLES)).astype(np.float32)
    beta = rng.random((RANDOM, SAMPLES)).astype(np.float32)
    ln_c = np.log(rng.gamma(2.0, 1.0, (RANDOM, SAMPLES))).astype(np.float32)
    once = [r * (_steps(np.full(1, 0.5 + k / (2.0 * LEVELS)), r, beta) - beta + 1) for k in range(LEVELS + 1)]
    return r, beta, ln_c, np.concatenate(once)


def _steps(weights: np.ndarray, r: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """t = floor(ln w / r + beta)"""
    return np.floor(np.log(weights).astype(np.float32)[:, None] / r + beta)


def bands(own: tuple[np.ndarray, np.ndarray], levels: np.ndarray) -> np.ndarray:
    """The band keys of a text. For each sample the shingle of least ln a = ln c - r (t - beta + 1) is taken, with t = floor(ln w / r + beta); two texts take the same (shingle, t) with the probability of their weighted similarity."""
    x, times = own
    r, beta, ln_c, once = _random()
    weights, level = weigh(own, levels), levels[counter(x)].astype(np.int64)
    at, row_c = (x & np.uint64(RANDOM - 1)).astype(np.int64), (x >> np.uint64(16) & np.uint64(RANDOM - 1)).astype(np.int64)
    best, taken = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64)
    for start in range(0, len(x), 4096):
        part = slice(start, start + 4096)
        ln_a = ln_c[row_c[part]] - once[level[part] * RANDOM + at[part]]
        many = start + np.flatnonzero(times[part] > 1)
        if len(many):
            ri, bi = r[at[many]], beta[at[many]]
            ln_a[many - start] = ln_c[row_c[many]] - ri * (_steps(weights[many], ri, bi) - bi + 1)
        k = ln_a.argmin(0)
        value = ln_a[k, np.arange(SAMPLES)]
        new = value < best
        best, taken = np.where(new, value, best), np.where(new, start + k, taken)
    own_r, own_beta = r[at[taken], np.arange(SAMPLES)], beta[at[taken], np.arange(SAMPLES)]
    t = np.floor(np.log(weights[taken]).astype(np.float32) / own_r + own_beta).astype(np.int64)
    sample = mixed(x[taken] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, c])
    return key.view(np.int64)


def _signatures(shared):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                keys = [bands(own, levels) if len(own[0]) else [] for own in shingles(part.column(2).to_pylist(), WORDS)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "md5", "keys"])

    return sign


def _verified(shared):
    def of(ids: pa.Array, texts: pa.Array) -> list:
        """The shingles of texts of which many may be of one id."""
        first: dict = {}
        for k, i in enumerate(ids):
            first.setdefault(i, k)
        found = dict(zip(first, shingles(texts.take(pa.array(list(first.values()))).to_pylist(), WORDS), strict=True))
        return [found[i] for i in ids]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(0, len(a), TEXTS):
                left, right = (of(ids[k : k + TEXTS], batch.column(c).slice(k, TEXTS)) for c, ids in ((2, a), (3, b)))
                keep += [k + n for n, (x, y) in enumerate(zip(left, right, strict=True)) if similarity(x, y, levels) >= SIMILAR]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return verify


def _weighed(shared):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                own = shingles(part.column(1).to_pylist(), WORDS)
                weights = [weigh(x, shared.value) for x in own]
                columns = [pa.array([x.view(np.int64) for x, _ in own], pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64())), pa.array([float(w.sum()) for w in weights])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc", "shingles", "weights", "weight"])

    return weighed


# --- groups ---


def starred(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as (a, b) with a > b that connect the same nodes: larger neighbours and then smaller ones are tied to a node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small_ = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return cut(small_.where("a != b").distinct())


def _tied(edges: DataFrame) -> bool:
    """Whether each node is tied to one other, which is tied to none: then that is the least of its component."""
    ends = edges.select(F.col("a").alias("node"), "b").unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("b")))
    wrong = ends.groupBy("node").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b").isNull()).alias("ends")).where("low != high or (low is not null and ends > 0)")
    return not wrong.take(1)


def components(edges: DataFrame) -> DataFrame:
    """node, least: the least node that each node of edges (a, b) is connected with, itself included. Each turn's edges are written; none come to the driver."""
    now = starred(edges)
    while not _tied(now):
        now = starred(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())


def _open(members: DataFrame, group: DataFrame) -> DataFrame:
    """key, doc, least: the members of buckets that are still in several groups."""
    placed = members.join(group.withColumnRenamed("node", "doc"), "doc")
    apart = placed.groupBy("key").agg(F.min("least").alias("g0"), F.max("least").alias("g1")).where("g0 < g1").select("key")
    return placed.join(apart, "key", "left_semi")


def _with_leader(placed: DataFrame, order: Column) -> DataFrame:
    """a, b: each member of a bucket with the one that comes first, where they are in different groups."""
    leaders = placed.groupBy("key").agg(F.min(F.struct(order.alias("order"), "doc", "least")).alias("l"))
    met = placed.join(leaders.select("key", F.col("l")["doc"].alias("leader"), F.col("l")["least"].alias("leader_group")), "key").where("least != leader_group")
    return met.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()


def _able(weighed: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of members of buckets (key, doc, least) those that can be similar to one of another group there, with weight and may; and their shingles.

    may is the weight of a text's shingles that texts of other groups have too, among those placed; no more can be shared with
    one of these. Similar texts a, b share SHARED * (weight_a + weight_b) at least: so a is left out where may_a / SHARED -
    weight_a is less than the least weight in the bucket, or its weight more than what any other can reach in this way. The
    second table has shingle, doc, w and n, the number of texts that hold the shingle, of shingles that two groups have.
    """
    of_doc = placed.select("doc", "least").distinct()
    each = weighed.join(of_doc, "doc").select("doc", "least", F.explode(F.arrays_zip("shingles", "weights")).alias("s")).select("doc", "least", F.col("s.shingles").alias("shingle"), F.col("s.weights").alias("w"))
    held = each.groupBy("shingle").agg(F.min("least").alias("g0"), F.max("least").alias("g1"), F.count("*").alias("n")).where("g0 < g1").select("shingle", "n")
    apart = cut(each.join(held, "shingle").select("shingle", "doc", "w", "n"))
    may = apart.groupBy("doc").agg(F.sum("w").alias("may")).join(weighed.select("doc", "weight"), "doc").withColumn("reach", F.col("may") / SHARED - F.col("weight"))
    reaching = placed.join(may, "doc")
    ends = reaching.groupBy("key").agg(F.min("weight").alias("lightest"), F.max("reach").alias("furthest"))
    able = reaching.join(ends, "key").where((F.col("reach") >= F.col("lightest") - 1e-6) & (F.col("weight") <= F.col("furthest") + 1e-6))
    return cut(able.select("key", "doc", "least", "weight", "may")), apart


def _by_rare_shingles(able: DataFrame, apart: DataFrame, keys: DataFrame) -> DataFrame:
    """a, b: the texts of different groups that share a band and can be similar, found by the rarest shingles.

    A text's shingles that two groups have are put in one order for all texts, rarest first; rest is the weight from one on. The
    first common shingle of two similar texts has SHARED * (weight_a + weight_b) or more of rest in both: so it is among
    those of rest SIMILAR * weight at least, in the lighter text of 2 * SHARED * weight. They are joined by these. Where most
    texts of a shingle are in one group, these are not joined with each other.
    """
    docs = able.select("doc", "least", "weight", "may").distinct()
    rest = F.col("may") - F.coalesce(F.sum("w").over(W.partitionBy("doc").orderBy("n", "shingle").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rare = apart.join(docs, "doc").withColumn("rest", rest).where(F.col("rest") >= SIMILAR * F.col("weight") - 1e-6).drop("w", "n", "may")
    sizes = rare.groupBy("shingle", "least").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("least", F.struct("n", "least")).alias("most"), F.count("*").alias("groups"))
    rare = cut(rare.join(sizes.where("groups > 1").select("shingle", "most"), "shingle").join(keys, "doc"))
    light, heavy = (rare.select("shingle", "most", *(F.col(c).alias(f"{side}_{c}") for c in ("doc", "least", "weight", "rest", "keys"))) for side in "ab")
    light = light.where(F.col("a_rest") >= 2 * SHARED * F.col("a_weight") - 1e-6)
    able = F.struct("a_weight", "a_doc") < F.struct("b_weight", "b_doc")
    able &= (F.col("a_least") != F.col("b_least")) & (F.least("a_rest", "b_rest") >= SHARED * (F.col("a_weight") + F.col("b_weight")) - 1e-6)
    able &= F.arrays_overlap("a_keys", "b_keys")
    own = light.shingle == heavy.shingle
    few = light.where("a_least != most").join(heavy, own & able)
    many = light.where("a_least = most").join(heavy.where("b_least != most"), own & able)
    return few.select("a_doc", "b_doc").unionByName(many.select("a_doc", "b_doc")).select(F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, md5, copy_of, group_id, kept for every row of docs (doc_id, text): one row for each, and no pairs.

    copy_of is the least id with the same text. Texts are linked if the weighted Jaccard similarity of their TF-IDF shingles
    of five words is 0.8 or more; group_id is the least id that is connected by links and copies, and kept says that the row has
    it. Texts that share a band are candidates. In each bucket all meet the least one, then, in ROUNDS, the one of which most
    is in other groups too. Of those still in several groups, texts meet that can be similar by the weight that they share at most
    and that have one of their rarest shingles in common. So every candidate pair is verified, within one group already, or
    proven to be no link.

    Texts without words (null ones count as empty) are copies of equal ones alone: blank texts of different blanks are different. Rows with a null id are kept,
    in no group. Rows of one id count as one document, with the text of least md5 if they differ. Ties go to the least id. Long texts are read whole; an empty table
    gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text")).withColumn("md5", F.md5("text"))
    named = rows.where("doc_id is not null")
    shared = spark.sparkContext.broadcast(frequencies(docs))
    signed = cut(named.select("doc_id", "md5", "text").mapInArrow(_signatures(shared), "doc_id long, md5 string, keys array<long>"))
    classes = cut(signed.groupBy("md5").agg(F.min("doc_id").alias("copy_of"), F.first("keys").alias("keys")))
    members = classes.select(F.explode("keys").alias("key"), F.col("copy_of").alias("doc"))
    several = members.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key")
    members = cut(members.join(several, "key").distinct())
    node = cut(members.select(F.col("doc").alias("node")).distinct().withColumn("least", F.col("node")))
    first = classes.groupBy(F.col("copy_of").alias("doc_id")).agg(F.min("md5").alias("md5")).join(node.select(F.col("node").alias("doc_id")), "doc_id")
    texts = cut(named.join(first, ["doc_id", "md5"], "left_semi").dropDuplicates(["doc_id", "md5"]).select("doc_id", "text"))
    state = {"group": node, "edges": None, "tested": None}

    def meet(pairs: DataFrame) -> bool:
        """Verifies the pairs (a, b) that weren't before, and joins the groups of those that are similar."""
        tested, edges = state["tested"], state["edges"]
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.take(1):
            return False
        state["tested"] = pairs if tested is None else tested.unionByName(pairs)
        told = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
        linked = cut(told.select("a", "b", "left", "right").mapInArrow(_verified(shared), "a long, b long"))
        if not linked.take(1):
            return False
        # one turn of stars: who is labelled alike is connected, though not all that are connected are labelled alike yet
        state["edges"] = starred(linked if edges is None else edges.unionByName(linked))
        state["group"] = labelled(state["edges"].groupBy(F.col("a").alias("node")).agg(F.min("b").alias("lower")))
        return True

    def labelled(lower: DataFrame) -> DataFrame:
        return cut(node.join(lower, "node", "left").select("node", F.coalesce("lower", "least").alias("least")))

    meet(_with_leader(_open(members, node), F.col("doc")))
    placed = cut(_open(members, state["group"]))
    if placed.take(1):
        wanted = placed.select(F.col("doc").alias("doc_id")).distinct()
        weighed = cut(texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_weighed(shared), "doc long, shingles array<long>, weights array<double>, weight double"))
        for _ in range(ROUNDS):
            able, _ = _able(weighed, placed)
            meet(_with_leader(able, -F.col("may") / F.col("weight")))
            placed = cut(_open(able.select("key", "doc"), state["group"]))
        able, apart = _able(weighed, placed)
        meet(_by_rare_shingles(able, apart, classes.groupBy(F.col("copy_of").alias("doc")).agg(F.min_by("keys", "md5").alias("keys"))))
    if state["edges"] is not None:
        state["group"] = labelled(components(state["edges"]).withColumnRenamed("least", "lower"))
    out_of = classes.select("md5", "copy_of").join(state["group"], F.col("copy_of") == F.col("node"), "left").select("md5", "copy_of", F.coalesce("least", "copy_of").alias("group_id"))
    out = signed.select("doc_id", "md5").join(out_of, "md5").withColumn("kept", F.col("doc_id") == F.col("group_id"))
    none = F.lit(None).cast("long")
    rest = rows.where("doc_id is null").select("doc_id", "md5", none.alias("copy_of"), none.alias("group_id"), F.lit(True).alias("kept"))
    return out.select("doc_id", "md5", "copy_of", "group_id", "kept").unionByName(rest)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns; rows with a null id stay.

    Rows of the ids that go are left out where they are; texts aren't moved unless more than SMALL ids go. Of rows that repeat an id
    the one of the least text by md5 stays. Empty tables give no rows; columns of any name pass through.
    """
    whole_row = docs.select(F.struct("*").alias("row"))
    ids = cut(near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    gone = ids.where("not kept or n > 1").select(F.col("doc_id").alias("gone"))
    doc = F.col("row")["doc_id"].cast("long")
    stays = whole_row.join(small(gone), doc == F.col("gone"), "left_anti")
    repeated = ids.where("kept and n > 1").select(F.col("doc_id").alias("again"))
    if not repeated.take(1):
        return stays.select("row.*")
    first = whole_row.join(small(repeated), doc == F.col("again"), "left_semi").groupBy(doc.alias("id")).agg(F.min_by("row", F.md5(F.coalesce(F.col("row")["text"], F.lit("")))).alias("row"))
    return stays.select("row.*").unionByName(first.select("row.*"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("md5")
