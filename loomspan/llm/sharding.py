"""Sharding by fixed virtual slots: records hash into slots, and a versioned map says which shard has which slot."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, exists, shared_folder, table, whole

#: Virtual slots; parts of a slot, each of which is ranked by itself (more slots keep windows small where there are more records);
#: how far from the mean a shard's bytes may be before the map is edited.
SLOTS, PARTS, TOLERANCE = 4096, 8, 0.001


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the shard of a slot; each edit gives a map with the next version. Its size is that of the slots, whatever the data."""

    shard_of: tuple[int, ...]
    shards: int
    version: int = 1

    @classmethod
    def first(cls, slots: int, shards: int) -> SlotMap:
        """Slots dealt to shards in turn, for a start without knowledge of loads."""
        return cls(tuple(k % shards for k in range(slots)), shards)

    @classmethod
    def balanced(cls, loads: np.ndarray, shards: int) -> SlotMap:
        """The slots, largest first, each to the shard that has least; ties go to the lower number."""
        of, heap = [0] * len(loads), [(0, s) for s in range(shards)]
        for slot in np.lexsort((np.arange(len(loads)), -loads)).tolist():
            load, shard = heapq.heappop(heap)
            of[slot] = shard
            heapq.heappush(heap, (load + int(loads[slot]), shard))
        return cls(tuple(of), shards)

    def rebalanced(self, loads: np.ndarray, tolerance: float = 0.02) -> SlotMap:
        """The next version: single slots go from the fullest to the emptiest shard until both are within the tolerance of the mean, or no move helps."""
        of = np.array(self.shard_of)
        sums = np.bincount(of, weights=loads, minlength=self.shards)
        mean = sums.mean()
        for _ in range(len(of)):
            high, low = int(sums.argmax()), int(sums.argmin())
            own = np.flatnonzero((of == high) & (loads > 0) & (loads < sums[high] - sums[low]))
            if sums[high] <= mean * (1 + tolerance) and sums[low] >= mean * (1 - tolerance) or not len(own):
                break
            slot = own[np.abs(loads[own] - (sums[high] - sums[low]) / 2).argmin()]
            of[slot] = low
            sums[high], sums[low] = sums[high] - loads[slot], sums[low] + loads[slot]
        return replace(self, shard_of=tuple(of.tolist()), version=self.version + 1)

    def grown(self, loads: np.ndarray) -> SlotMap:
        """One more shard, which takes slots from the fullest ones until it has its share; no other slot moves."""
        of = np.array(self.shard_of)
        sums = np.bincount(of, weights=loads, minlength=self.shards + 1)
        share = loads.sum() / (self.shards + 1)
        while sums[self.shards] < share:
            high = int(sums[: self.shards].argmax())
            own = np.flatnonzero((of == high) & (loads > 0) & (loads <= share - sums[self.shards]))
            if not len(own):
                break
            slot = own[loads[own].argmax()]
            of[slot] = self.shards
            sums[high], sums[self.shards] = sums[high] - loads[slot], sums[self.shards] + loads[slot]
        return SlotMap(tuple(of.tolist()), self.shards + 1, self.version + 1)

    def even(self, loads: np.ndarray, tolerance: float) -> bool:
        """Whether all shards are within the tolerance of the mean."""
        sums = np.bincount(np.array(self.shard_of), weights=loads, minlength=self.shards)
        return bool((np.abs(sums - sums.mean()) <= tolerance * sums.mean()).all())

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored maps."""
        rows = [(self.version, self.shards, k, s) for k, s in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "version int, shards int, slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one by default."""
        maps = spark.read.parquet(path)
        version = maps.agg(F.max("version")).first()[0] if version is None else version
        rows = maps.where(F.col("version") == version).orderBy("slot").collect()  # as many as there are slots
        return cls(tuple(r["shard"] for r in rows), rows[0]["shards"], version)


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, and the virtual slot that a hash of the three gives; part splits a slot's records further."""
    rows = docs.select("doc_id", (F.octet_length(whole()) + 8).cast("long").alias("size"), F.crc32(whole().cast("binary")).alias("text_crc32"))
    h = F.xxhash64("doc_id", "text_crc32", "size")
    return rows.select("*", F.pmod(h, F.lit(slots)).cast("int").alias("virtual_slot"), F.pmod(F.shiftright(h, 32), F.lit(PARTS)).cast("int").alias("part"))


def current_map(spark: SparkSession, maps: str, loads: np.ndarray, shards: int, tolerance: float) -> SlotMap:
    """The last map stored under the path, edited and stored as the next version if its shards aren't even or their number is not the
    one asked for; the first map where none is stored."""
    now = SlotMap.load(spark, maps) if exists(spark, maps) else None
    if now is None:
        now = SlotMap.first(len(loads), shards)
        now.save(spark, maps)
    if len(now.shard_of) != len(loads) or now.shards > shards:
        raise ValueError(f"the map under {maps} has {len(now.shard_of)} slots and {now.shards} shards, not {len(loads)} and at most {shards}")
    while now.shards < shards:
        now = now.grown(loads)
        now.save(spark, maps)
    if not now.even(loads, tolerance):
        now = now.rebalanced(loads, tolerance)
        now.save(spark, maps)
    return now


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, maps: str | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Puts every row of docs (doc_id, text) into a shard; law `bytes`: the shards' sizes are near equal.

    Records hash into slots, and bytes are summed per slot. The slot-to-shard map is the last version stored under maps, edited and
    stored anew if the bytes ask for it; without a path, one in the shared folder is begun. slot is the record's place in its
    shard, gapless from 0: the records of lower virtual slots come first, then those of the same one in the order of part,
    doc_id, checksum and size; records that tie in all of these are alike but for columns that aren't read. Null texts count
    as empty (size 8, checksum 0); null ids and repeated rows are records like others; an empty table gives no rows. Other
    columns are ignored. One text's records are spread, as their ids count, so that a hot text fills no shard.
    """
    spark = docs.sparkSession
    rows = cut(records(docs, slots))
    loads = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    held = loads.collect()  # slots times PARTS rows at most, whatever the data
    at = np.array([r["virtual_slot"] * PARTS + r["part"] for r in held], dtype=np.int64)
    counts, sizes = np.zeros(slots * PARTS, np.int64), np.zeros(slots * PARTS, np.int64)
    counts[at], sizes[at] = [r["n"] for r in held], [r["bytes"] for r in held]
    slot_map = current_map(spark, maps or f"{shared_folder(spark)}/slot-maps-{uuid.uuid4()}", sizes.reshape(slots, PARTS).sum(1), shards, tolerance)
    of = np.repeat(np.array(slot_map.shard_of), PARTS)
    before = np.zeros(slots * PARTS, np.int64)
    for s in range(slot_map.shards):
        own = of == s
        before[own] = np.cumsum(counts[own]) - counts[own]
    places = [(int(k // PARTS), int(k % PARTS), int(of[k]), int(before[k])) for k in np.flatnonzero(counts)]
    placed = spark.createDataFrame(places, "virtual_slot int, part int, shard int, before long")  # bounded like held
    rank = F.row_number().over(W.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(placed), ["virtual_slot", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
