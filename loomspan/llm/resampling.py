"""Importance resampling towards a target: documents are drawn without replacement by how much their word runs resemble the target's.

Word runs hash into buckets; the log ratio of a bucket's shares in target and corpus is its gain, and a document weighs the sum of its
gains, looked up in one array. Gumbel noise from the document's id makes the highest scores a weighted draw. The rows that can be
drawn are sorted within their partitions; these runs meet by ranges of the score, where a tournament tree merges their blocks in
order and stops at the last one drawn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Buckets of the features, and the words of the longest one.
BUCKETS, LONGEST = 10_000, 3
#: Rows (about) that are looked at for the bounds of ranges; ranges at most, and rows of one at least; rows of a block.
FENCES, RANGES, LEAST, BLOCK = 20_000, 1024, 100, 1024
#: Upper case to lower case, and what is no digit, letter or part of a character beyond ASCII to a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: digits, letters and all characters beyond ASCII, A to Z in lower case."""
    return text.translate(_PLAIN).split()


def buckets_of(words: list[bytes]) -> np.ndarray:
    """The buckets of all runs of 1 to LONGEST words, repeats included; a run's checksum goes on from that of the run without its last word."""
    sums = list(map(crc32, words))
    found, follow = [sums], [b" " + w for w in words]
    for k in range(1, LONGEST):
        sums = list(map(crc32, follow[k:], sums))
        found.append(sums)
    return np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found))) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket and n: how often the features of all texts (text) fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                n += np.bincount(buckets_of(words_of(text.as_py())), minlength=BUCKETS)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], names=["bucket", "n"])

    part = texts.where("text is not null").select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(texts: DataFrame) -> list[int]:
    """The counts of all buckets, BUCKETS numbers whatever the texts."""
    n = [0] * BUCKETS
    for row in bucket_counts(texts).collect():
        n[row.bucket] = row.n
    return n


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Of each bucket, the log of its share in the target over that in the corpus, each with one more feature a bucket, in thousandths."""
    s, t = float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weighed(docs: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of docs (doc_id, text)."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(_counted(docs), _counted(target)))  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = [], [], []
            for text in batch.column(1):
                own = words_of(text.as_py() or b"")
                of = buckets_of(own)
                words.append(len(own))
                features.append(len(of))
                weight.append(int(gain.value[of].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)


class Tournament:
    """A tree of matches over the open blocks: each inner node holds the leaf below it whose key comes first. Leaves are taken again once they are empty."""

    def __init__(self) -> None:
        self.size, self.keys, self.free = 1, [None], [0]
        self.first = [0, 0]

    def _match(self, a: int, b: int) -> int:
        if self.keys[a] is None or self.keys[b] is None:
            return b if self.keys[a] is None else a
        return a if self.keys[a] < self.keys[b] else b

    def put(self, leaf: int, key: tuple | None) -> None:
        """Another key (None: no more) at a leaf; the matches above it are played again."""
        self.keys[leaf] = key
        node = (self.size + leaf) // 2
        while node:
            a, b = 2 * node, 2 * node + 1
            self.first[node] = self._match(*(x - self.size if x >= self.size else self.first[x] for x in (a, b)))
            node //= 2
        if key is None:
            self.free.append(leaf)

    def add(self, key: tuple) -> int:
        """A leaf for one more block; the tree doubles when all are taken."""
        if not self.free:
            held, self.size = self.keys, 2 * self.size
            self.keys, self.first = held + [None] * len(held), [0] * self.size
            self.free = list(range(self.size - 1, len(held) - 1, -1))
            for node in range(self.size - 1, 0, -1):
                self.first[node] = self._match(*(x - self.size if x >= self.size else self.first[x] for x in (2 * node, 2 * node + 1)))
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    def winner(self) -> int | None:
        leaf = self.first[1] if self.size > 1 else 0
        return None if self.keys[leaf] is None else leaf


def _key(block: dict, at: int) -> tuple:
    """The order of rows: high scores, then small ids (null last), then the run."""
    doc = block["ids"][at]
    return -block["scores"][at], doc is None, doc or 0, block["run"], block["block"], at


def merged(blocks: Iterator[dict], wanted: int) -> Iterator[tuple[dict, int, int | None]]:
    """Of one range's blocks, in the order of their first rows: each row as (block, place in it, how many came before), in order until `wanted` have come; then the others with None.

    A block is opened when its first row is next. Blocks of a run follow each other, so that one block a run is open at a time.
    """
    tree, opened, places, came = Tournament(), {}, {}, 0

    def upto(limit: tuple | None) -> Iterator[tuple[dict, int, int | None]]:
        nonlocal came
        while came < wanted and (leaf := tree.winner()) is not None and (limit is None or tree.keys[leaf] < limit):
            block, at = opened[leaf], places[leaf]
            yield block, at, came
            came += 1
            places[leaf] = at + 1
            tree.put(leaf, _key(block, at + 1) if at + 1 < len(block["ids"]) else None)

    for block in blocks:
        if came < wanted:
            yield from upto(_key(block, 0))
        if came < wanted:
            leaf = tree.add(_key(block, 0))
            opened[leaf], places[leaf] = block, 0
        else:
            yield from ((block, at, None) for at in range(len(block["ids"])))
    yield from upto(None)
    for leaf, key in enumerate(tree.keys):
        if key is not None:
            yield from ((opened[leaf], at, None) for at in range(places[leaf], len(opened[leaf]["ids"])))


def _before(ids: np.ndarray, scores: np.ndarray, run: int, bound: tuple[int, int, int]) -> int:
    """How many rows, in order, come before a bound (score, id, run); null ids are the greatest number here, which no bound has."""
    a, b = np.searchsorted(-scores, -bound[0], "left"), np.searchsorted(-scores, -bound[0], "right")
    return int(a + np.searchsorted(ids[a:b], bound[1], "right" if run < bound[2] else "left"))


RUNS = "range int, run int, block long, head_score long, head_id long, ids array<long>, features array<long>, weights array<long>, scores array<long>"
DRAWN = "doc_id long, n_features long, weight long, score long, rank long"
NULL_ID = np.iinfo(np.int64).max


def runs(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """The rows of each partition in order, as blocks that end where a range does."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, scores = batch.column(0).fill_null(NULL_ID).to_numpy(), batch.column(3).to_numpy()
            ends = [0, *(_before(ids, scores, run, b) for b in bounds), batch.num_rows]
            cuts = [(k, a, min(a + BLOCK, ends[k + 1])) for k in range(len(ends) - 1) for a in range(ends[k], ends[k + 1], BLOCK)]
            if cuts:
                columns = [batch.column(k).to_pylist() for k in range(4)]
                out = [(k, run, made + j, columns[3][a], columns[0][a], *(c[a:b] for c in columns)) for j, (k, a, b) in enumerate(cuts)]
                made += len(cuts)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *(pa.list_(pa.int64()),) * 4)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RUNS.split(", ")])

    return rows.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id")).select("doc_id", "n_features", "weight", "score").mapInArrow(cut_up, RUNS)


def ranked(blocks: DataFrame, offsets: dict[int, int], wanted: int) -> DataFrame:
    """The rows of all blocks, those among the first `wanted` with their rank; offsets: how many rows lie in the ranges before each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                for k in range(batch.num_rows):
                    yield batch.slice(k, 1).to_pylist()[0]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in DRAWN.split(", ")])

        source, out = each(), []
        head = next(source, None)
        while head is not None:
            now, following = head["range"], []

            def of_range(first=head, now=now, following=following) -> Iterator[dict]:
                yield first
                for block in source:
                    if block["range"] != now:
                        following.append(block)
                        return
                    yield block

            for block, at, came in merged(of_range(), max(0, wanted - offsets[now])):
                rank = None if came is None else offsets[now] + came + 1
                out.append((block["ids"][at], block["features"][at], block["weights"][at], block["scores"][at], rank))
                if len(out) == 8192:
                    yield packed(out)
                    out = []
            head = following[0] if following else None
        if out:
            yield packed(out)

    dealt = blocks.repartition(max(1, len(offsets)), "range").sortWithinPartitions("range", F.desc("head_score"), F.asc_nulls_last("head_id"), "run", "block")
    return dealt.mapInArrow(merge, DRAWN)


def _bounds(fences: list[tuple], upto: int, ranges: int) -> list[tuple[int, int, int]]:
    """Every so many of the first `upto` fences, in order; null and greatest ids bound nothing."""
    own = [fences[k * upto // ranges] for k in range(1, ranges)]
    return sorted({(s, d, r) for s, d, r in own if d is not None and d != NULL_ID}, key=lambda b: (-b[0], b[1], b[2]))


def _candidates(eligible: DataFrame, fences: list[tuple], upto: int) -> tuple[DataFrame, Column]:
    """The rows up to a fence, by score and id, and that as a condition."""
    if upto >= len(fences):
        return eligible, F.lit(True)
    score, doc, _ = fences[upto]
    within = (F.col("score") > score) | (F.lit(True) if doc is None else F.coalesce(F.col("doc_id") <= doc, F.lit(False))) & (F.col("score") == score)
    return eligible.where(within), within


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of docs (doc_id, text), drawn towards target (text).

    Of the N rows with least_words words, the floor(percent * N / 100) highest scores are drawn and ranked 1, 2, 3 on; ties go to the
    smaller id, a null id comes last. Undrawn rows have no rank. Null and empty texts have no features and weigh 0; repeated rows
    score alike, and each takes a rank of its own, in any order; long texts are read whole; an empty target weighs all by how rare
    their runs are; an empty table gives no rows. Other columns are ignored.

    Two scans of the texts; what they weigh is written once. About FENCES rows give the bounds of ranges: these need not be exact, as
    ranges are counted and ranks start from the counts. Only rows above the bound of the draw are sorted and shuffled, a block of one
    run at a time is open in a merge, and equal rows of different runs may lie in different ranges.
    """
    spark = docs.sparkSession
    rows = stored(weighed(docs, target, seed))
    fit = F.col("n_words") >= least_words
    eligible = rows.where(fit)
    n = eligible.count()
    wanted = percent * n // 100
    plain = rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not wanted:
        return plain
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 40)) < int(min(1.0, FENCES / n) * (1 << 40))
    seen = eligible.select("score", "doc_id", F.spark_partition_id().alias("run"), part.alias("chosen")).where("chosen").drop("chosen").collect()  # about FENCES rows
    fences = sorted((tuple(r) for r in seen), key=lambda f: (-f[0], f[1] is None, f[1] or 0, f[2]))
    share = wanted / n * len(fences)
    spare = 0 if len(fences) == n else 8 * math.sqrt(share) + 50
    while True:
        upto = min(len(fences), int(share + spare) + 1)
        chosen, within = _candidates(eligible, fences, upto)
        blocks = stored(runs(chosen, _bounds(fences, upto, max(1, min(RANGES, wanted // LEAST)))))
        sizes = dict(blocks.groupBy("range").agg(F.sum(F.size("ids")).alias("n")).collect())  # a row for each range
        if sum(sizes.values()) >= wanted:
            break
        spare = 2 * spare + 50
    offsets, before = {}, 0
    for k in sorted(sizes):
        offsets[k], before = before, before + sizes[k]
    rest = rows.where(~(fit & within)).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked(blocks, offsets, wanted))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
