"""What a chunk knows of the entities in its document's earlier chunks: in batch by window, in a stream by keyed state.

Answers are (doc_id, chunk, number, type, surfaces): the entities that a chunk's answer names. A document's numbers stay its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KNOWN = "doc_id string, number int, type string, surfaces array<string>, last_seen int"


def known(answers: DataFrame) -> DataFrame:
    """doc_id, number, type (of the first answer), surfaces (in the order first seen), last_seen: after all chunks of a document."""
    heads = answers.groupBy("doc_id", "number").agg(F.min_by("type", "chunk").alias("type"), F.max("chunk").alias("last_seen"))
    said = answers.select("doc_id", "number", "chunk", F.posexplode("surfaces").alias("pos", "s")).groupBy("doc_id", "number", "s").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    lists = said.groupBy("doc_id", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("surfaces"))
    return heads.join(lists, ["doc_id", "number"], "left").select("doc_id", "number", "type", "surfaces", "last_seen")


def listed(known_rows: DataFrame, most: int = 40, surfaces: int = 4) -> DataFrame:
    """The entities that a prompt lists: the first of the document always, then the latest seen, `most` in all, in order of number; names before descriptions, `surfaces` of them at most."""
    first = F.col("number") == F.min("number").over(W.partitionBy("doc_id"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(first.desc(), F.col("last_seen").desc(), "number"))
    name = lambda s: s.rlike(r"^\p{Lu}|^\d")
    shown = F.slice(F.concat(F.filter("surfaces", name), F.filter("surfaces", lambda s: ~name(s))), 1, surfaces)
    return known_rows.withColumn("_n", rank).where(F.col("_n") <= most).select("doc_id", "number", "type", shown.alias("surfaces"), "last_seen")


def known_before(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each chunk (doc_id, chunk) what its document's earlier chunks named: doc_id, chunk, number, type, last_seen."""
    per = answers.groupBy("doc_id", "number").agg(F.min_by("type", "chunk").alias("type"), F.array_sort(F.collect_set("chunk")).alias("_at"))
    seen = chunks.select("doc_id", "chunk").join(per, "doc_id").where(F.col("_at")[0] < F.col("chunk"))  # a row for each row of the result
    return seen.select("doc_id", "chunk", "number", "type", F.array_max(F.filter("_at", lambda c: c < F.col("chunk"))).alias("last_seen"))


class KnownEntities(StatefulProcessor):
    """A document's known entities as map state, an entry for each number: a batch reads and writes the entries that it names, no others."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "number int", "type string, surfaces array<string>, last_seen int", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        given = pd.concat(list(rows)).sort_values(["chunk", "number"])
        for number, own in given.groupby("number", sort=True):
            at = (int(number),)
            kind, surfaces, last = self.known.getValue(at) if self.known.containsKey(at) else (own.type.iloc[0], [], -1)
            said = [s for listed in own.surfaces if listed is not None for s in listed]
            now = (kind, list(dict.fromkeys([*surfaces, *said])), max(int(last), int(own.chunk.max())))
            self.known.updateValue(at, now)
            yield pd.DataFrame({"doc_id": [key[0]], "number": pd.Series(at, dtype="int32"), "type": [now[0]], "surfaces": [now[1]], "last_seen": pd.Series([now[2]], dtype="int32")})

    def close(self) -> None:
        pass


#: What a session needs for state of this kind.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def known_stream(answers: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The same over a stream of answers, whose chunks come in order: each known entity that a batch names, as it is now. The last row of a number counts.

    State is keyed by document and number and never crosses documents; forget_ms: an entity that nothing names for that long is
    forgotten, by default none is. The session needs STATE_STORE.
    """
    return answers.groupBy("doc_id").transformWithStateInPandas(KnownEntities(forget_ms), KNOWN, "update", "processingTime" if forget_ms else "none")


def known_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of known entities holds in its checkpoint, as known() has it: read from the state, for a look at it or a new start."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "known").load()
    return state.select(F.col("key.doc_id").alias("doc_id"), F.col("user_map_key.number").alias("number"), "user_map_value.type", "user_map_value.surfaces", "user_map_value.last_seen")


def arriving(docs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of documents (doc_id, text, ts), each id once within the delay."""
    return docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"])


def activity(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) per window and type; batch and stream agree."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
