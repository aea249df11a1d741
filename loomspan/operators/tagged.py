"""Names that a tagger finds beside a proposer's entities: tags of tokens to spans, and spans to new entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tagging
from .rows import flat_map


def tagged_spans(tokens: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks (key, text, tokens array<struct<start, end, tag>>, in order) -> key, start, end, type, surface."""

    def make(text, given):
        text, given = text or "", given or []
        for a, b, kind in tagging.decode(text, [(t["start"], t["end"]) for t in given], [t["tag"] for t in given]):
            yield a, b, kind, text[a:b]

    return flat_map(tokens, [key], ["text", "tokens"], make, "start int, end int, type string, surface string")


def labelled_tokens(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks (key, text, tokens array<struct<start, end>>, entities) -> key and the tag of each token, by the names of the gold entities."""

    def make(text, given, entities):
        named = [(m, e["type"]) for e in entities or [] for m in tagging.name_mentions(e["name"], e["mentions"] or [])]
        yield (tagging.encode(text or "", [(t["start"], t["end"]) for t in given or []], tagging.labelled_spans(text or "", named)),)

    return flat_map(chunks, [key], ["text", "tokens", "entities"], make, "tags array<string>")


def augmented(entities: DataFrame, spans: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Entities (key, n, type, name, mentions) with those tagged surfaces (key, start, type, surface) that no entity of the chunk has, whatever
    their case: each once, where it stands first, numbered on from the highest number."""
    low = F.lower("surface")
    known = entities.select(key, F.explode(F.concat(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>")))).alias("_k")).select(key, F.lower("_k").alias("_k")).distinct()
    new = spans.withColumn("_k", low).join(known, [key, "_k"], "left_anti").groupBy(key, "_k").agg(F.min(F.struct("start", "surface", "type")).alias("s"))
    last = entities.groupBy(key).agg(F.max("n").alias("_last"))
    number = F.coalesce("_last", F.lit(0)) + F.row_number().over(W.partitionBy(key).orderBy(F.col("s")["start"], "_k"))
    more = new.join(last, key, "left").select(key, number.cast("int").alias("n"), F.col("s")["type"].alias("type"), F.col("s")["surface"].alias("name"), F.array(F.col("s")["surface"]).alias("mentions"))
    return entities.select(key, "n", "type", "name", "mentions").unionByName(more)
