"""What a pair scorer learns: the label classes of each pair of a chunk's entities, by gold or by entities aligned with gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ontology import label_classes


def _directed(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Relations (chunk_id, type, src, tgt) as pairs a < b with the class's direction: > from a to b and for symmetric types, < from b to a."""
    r = relations.where("src != tgt").join(F.broadcast(types.select("type", "symmetric")), "type")  # a schema's size
    forward = F.col("symmetric") | (F.col("src") < F.col("tgt"))
    return r.select("chunk_id", F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b"), "type", F.when(forward, ">").otherwise("<").alias("direction"))


def gold_targets(pairs: DataFrame, relations: DataFrame, types: DataFrame) -> DataFrame:
    """Pairs (chunk_id, a, b) with labels, an array of (type, direction), by gold relations between entity numbers; none where gold says nothing."""
    known = _directed(relations, types).join(F.broadcast(label_classes(types)), ["type", "direction"], "left_semi")
    labels = known.groupBy("chunk_id", "a", "b").agg(F.array_sort(F.collect_set(F.struct("type", "direction"))).alias("labels"))
    empty = F.array().cast("array<struct<type: string, direction: string>>")
    return pairs.join(labels, ["chunk_id", "a", "b"], "left").withColumn("labels", F.coalesce("labels", empty))


def aligned_targets(pairs: DataFrame, relations: DataFrame, alignment: DataFrame, types: DataFrame) -> DataFrame:
    """The same for pairs of a proposer's entities: those that two are aligned with (alignment: chunk_id, pred_ent, gold_ent) give
    their gold relations, with the direction that the proposer's numbers have; two that are aligned with one entity give none."""
    end = lambda k: alignment.where("gold_ent is not null").select("chunk_id", F.col("pred_ent").alias(k), F.col("gold_ent").alias(f"{k}_gold"))
    both = pairs.join(end("a"), ["chunk_id", "a"]).join(end("b"), ["chunk_id", "b"]).where("a_gold != b_gold")
    r = relations.join(F.broadcast(types.select("type", "symmetric")), "type")
    x = both.join(r.withColumnsRenamed({"src": "a_gold", "tgt": "b_gold"}), ["chunk_id", "a_gold", "b_gold"]).withColumn("direction", F.lit(">"))
    y = both.join(r.withColumnsRenamed({"src": "b_gold", "tgt": "a_gold"}), ["chunk_id", "a_gold", "b_gold"]).withColumn("direction", F.when(F.col("symmetric"), ">").otherwise("<"))
    labels = x.unionByName(y).groupBy("chunk_id", "a", "b").agg(F.array_sort(F.collect_set(F.struct("type", "direction"))).alias("labels"))
    empty = F.array().cast("array<struct<type: string, direction: string>>")
    return pairs.join(labels, ["chunk_id", "a", "b"], "left").withColumn("labels", F.coalesce("labels", empty))


def multi_hot(targets: DataFrame, types: DataFrame) -> DataFrame:
    """A column of 0 and 1 for each class, in order of type and direction, in place of the labels."""
    classes = [tuple(r) for r in label_classes(types).orderBy("type", "direction").collect()]  # a schema's size
    hot = F.array(*(F.array_contains("labels", F.struct(F.lit(t).alias("type"), F.lit(d).alias("direction"))).cast("int") for t, d in classes))
    return targets.select("chunk_id", "a", "b", hot.alias("target"))
