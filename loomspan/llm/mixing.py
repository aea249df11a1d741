"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, fingerprint, small, table, whole

BLOCK_WORDS, CAP, WEIGHTS, SEED = 64, 3, (1, 2, 3), 20_24
#: About so many documents are summed together, as many slots are ranked together, and so many sums of these are summed in turn:
#: no window holds more, whatever the size of a source, up to the third power of it.
STRETCH = 1024
#: Bits of a van der Corput point; as many slots as 2 to this power are distinct.
BITS = 40


def van_der_corput(k: Column) -> Column:
    """The bits of k mirrored at the binary point: 0, 1/2, 1/4, 3/4, 1/8, ..."""
    return F.conv(F.reverse(F.lpad(F.bin(k), BITS, "0")), 2, 10).cast("double") / F.lit(float(1 << BITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> source_rank, weight and target, a double.

    Sources by code point, null last, weigh weights in turn and share the sum of all sizes; a target stops at cap times
    its source's size, and the others share what is over by weight. Sorted by cap * size / weight, the first source
    that the remaining level leaves below its cap gives the level of all after it.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("source_rank", F.lit(len(weights))) + 1).cast("double"))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * float(cap)).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    w = W.orderBy("ratio", "source_rank")
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(full) - F.coalesce(F.sum("ceiling").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_rank", "level"))).over(full)["level"]
    return ranked.withColumn("target", F.least("ceiling", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("ceiling", "ratio", "level")


def blocks(target: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_blocks (a source is cut into blocks of as near block_words words as divide it evenly), each of `least` words or, in
    the first `longer` of them, one more; and draws, the blocks that make up the target."""
    n = F.greatest(F.lit(1), F.round(F.col("source_size") / block_words).cast("long"))
    df = target.withColumn("n_blocks", n)
    return (
        df.withColumn("least", F.floor(F.col("source_size") / F.col("n_blocks")))
        .withColumn("longer", F.col("source_size") - F.col("least") * F.col("n_blocks"))
        .withColumn("draws", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    )


def _before(counts: DataFrame, at: str, n: str) -> DataFrame:
    """source_rank, at, before: for rows (source_rank, at, n), how much of n stands before each in its source, in the order of `at`, a number from 0 on. Two windows, each over STRETCH rows about."""
    coarse = counts.withColumn("coarse", F.floor(F.col(at) / STRETCH))
    sums = coarse.groupBy("source_rank", "coarse").agg(F.sum(n).alias("sum"))
    upto = sums.select("source_rank", "coarse", (F.sum("sum").over(W.partitionBy("source_rank").orderBy("coarse")) - F.col("sum")).alias("base"))
    within = F.sum(n).over(W.partitionBy("source_rank", "coarse").orderBy(at)) - F.col(n)
    return coarse.withColumn("within_coarse", within).join(upto, ["source_rank", "coarse"]).select("source_rank", at, (F.col("base") + F.col("within_coarse")).alias("before"))


def schedule(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """slot, source_rank, rank (of the slot among its source's), block: the order in which the mix takes blocks.

    sources: source_rank, n_blocks, draws. The point of a slot falls into one source's part of the cumulative draws. A grid
    of cells turns that search into an equal join: each source goes to the cells that it meets.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("draws").alias("draws"), F.count("*").alias("n")).first()
    n_slots, cells = int(round(total["draws"] or 0)), 1 << max(6, (8 * total["n"]).bit_length())
    upto = F.sum("draws").over(W.orderBy("source_rank").rowsBetween(W.unboundedPreceding, 0))
    parts = sources.where("draws > 0").withColumn("high", upto / F.lit(float(total["draws"] or 1))).withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("source_rank")), F.lit(0.0)))
    parts = parts.withColumn("high", F.when(F.lead("high").over(W.orderBy("source_rank")).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    met = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells)))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * cells))
    slots = slots.join(small(met.select("cell", "low", "high", "source_rank", "n_blocks")), "cell").where("point >= low and point < high")
    slots = slots.select("slot", "source_rank", "n_blocks", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    before = _before(slots.groupBy("source_rank", "stretch").agg(F.count("*").alias("n")), "stretch", "n")
    within = F.row_number().over(W.partitionBy("source_rank", "stretch").orderBy("slot"))
    ranked = slots.withColumn("within", within).join(before, ["source_rank", "stretch"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.where(F.col("rank") < cap * F.col("n_blocks")).select("slot", "source_rank", "rank", F.pmod("rank", "n_blocks").alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of docs (doc_id, source, text): size, source_size, target (both of its source) and taken, in words.

    A source's documents are shuffled by a hash into one stream, which is cut into equal-token blocks; the schedule's slots
    of a source take its blocks in turn, and again from the first when all are taken, up to cap times. taken sums the words
    of a document in the blocks taken, as often as they are. Rows without words (null or blank texts) take 0; a null source
    is a source; repeated rows stand beside each other; an empty table gives no rows. Other columns are ignored. Reruns
    agree: ties of the hash go by doc_id, size and text.
    """
    h = F.xxhash64(F.lit(seed), "doc_id", "source")
    rows = docs.select("doc_id", "source", fingerprint(F.col("doc_id"), F.col("source"), F.col("text")).alias("row_key"), F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size")).withColumn("h", h)
    rows = cut(rows)
    held = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")))
    runs = 1 << max(4, ((held.agg(F.sum("n_rows")).first()[0] or 0) // STRETCH).bit_length())
    sources = cut(blocks(targets(held.drop("n_rows"), weights, cap), block_words))
    named = sources.select(F.col("source").alias("name"), "source_rank", "source_size", "target", "n_blocks", "least", "longer")
    rows = rows.join(small(named), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("run", F.pmod("h", F.lit(runs)))
    filled = rows.where("size > 0")
    before = _before(filled.groupBy("source_rank", "run").agg(F.sum("size").alias("n")), "run", "n")
    within = F.sum("size").over(W.partitionBy("source_rank", "run").orderBy("h", "doc_id", "size", "row_key").rowsBetween(W.unboundedPreceding, 0))
    filled = filled.withColumn("within", within).join(before, ["source_rank", "run"]).withColumn("start", F.col("before") + F.col("within") - F.col("size"))
    edge = F.col("longer") * (F.col("least") + 1)
    of = lambda x: F.when(x < edge, F.floor(x / (F.col("least") + 1))).otherwise(F.col("longer") + F.floor((x - edge) / F.col("least")))
    begin = lambda j: j * F.col("least") + F.least(j, F.col("longer"))
    pieces = filled.withColumn("block", F.explode(F.sequence(of(F.col("start")), of(F.col("start") + F.col("size") - 1))))
    overlap = F.least(F.col("start") + F.col("size"), begin(F.col("block") + 1)) - F.greatest(F.col("start"), begin(F.col("block")))
    taken = schedule(sources, cap).groupBy("source_rank", "block").agg(F.count("*").alias("times"))
    pieces = pieces.withColumn("words", overlap).join(taken, ["source_rank", "block"], "left")
    got = pieces.groupBy("doc_id", "row_key", "source", "source_rank", "start", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "source", "row_key"]
    return got.select(columns).unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def repeat_rows(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them: their taken words over their size, rounded; with all columns, whatever these are called.

    Rows that are alike share their copies evenly. Rows without words go; an empty table gives no rows. The one shuffle of the
    texts, by a hash of the row, is also the shuffle that a mix needs.
    """
    taken = mix(docs, **how).where("size > 0").groupBy("row_key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = cut(taken.select("row_key", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0"))
    row = F.col("row")
    rows = docs.select(F.struct("*").alias("row")).withColumn("row_key", fingerprint(row["doc_id"], row["source"], row["text"]))
    return rows.join(copies, "row_key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
