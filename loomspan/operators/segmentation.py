"""Segmentation of documents: chunks, paragraphs, sentences and windows as tables. Null texts count as empty and give no rows.

What is cut by patterns and windows is made by DataFrame functions (islands); greedy windows over one text's sentences or lines and its cleaning run as one function a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment
from .islands import chunks, headings, numbered_sentences, paragraphs, sentences, verbalized  # noqa: F401  these are segmentation too
from .rows import flat_map

SPAN = "k int, start int, end int, text string"


def spans(docs: DataFrame, cut, key: str = "doc_id") -> DataFrame:
    """key, k, start, end, text for a function that cuts a text into spans."""
    return flat_map(docs, [key], ["text"], lambda t: ((k, a, b, (t or "")[a:b]) for k, (a, b) in enumerate(cut(t or ""))), SPAN)


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, k, start, end of the filled lines of texts without the blanks around them, by DataFrame functions; only lengths are shuffled, and a null text has none."""
    from pyspark.sql import Window as W

    line = docs.select(key, F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    size = lambda c: F.char_length(c)
    body = F.regexp_replace("_line", r"(?U)^\s+", "")
    line = line.select(key, "_i", size("_line").alias("_n"), (size("_line") - size(body)).alias("_lead"), size(F.regexp_replace(body, r"(?U)\s+$", "")).alias("_body"))
    w = W.partitionBy(key).orderBy("_i")
    line = line.withColumn("_at", F.coalesce(F.sum(F.col("_n") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_lead")).where("_body > 0")
    start = F.col("_at").cast("int")
    return line.select(key, (F.row_number().over(w) - 1).alias("k"), start.alias("start"), (start + F.col("_body")).alias("end"))


def sentence_windows(docs: DataFrame, max_chars: int, overlap: int = 1, key: str = "chunk_id") -> DataFrame:
    return spans(docs, lambda t: segment.sentence_windows(t, max_chars, overlap), key)


def line_windows(docs: DataFrame, words: int = 300, key: str = "doc_id") -> DataFrame:
    return spans(docs, lambda t: segment.line_windows(t, words), key)


def tidied(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the cleaned text; a null text stays null."""
    return flat_map(docs, [key], ["text"], lambda t: [(None if t is None else segment.tidy(t),)], "text string")


def word_count(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def with_sentence(mentions: DataFrame, sentence_table: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions with sent_start and sent_end of the sentence that holds their start, null between sentences.

    An as-of join without a range join: sentences and mentions of a document are put in one order, and each mention takes the
    last sentence that begins no later.
    """
    from pyspark.sql import Window as W

    s = sentence_table.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("start", "end").alias("_sentence"))
    m = mentions.select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.struct(*mentions.columns).alias("_row"))
    w = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    both = s.unionByName(m, allowMissingColumns=True).withColumn("_last", F.last("_sentence", ignorenulls=True).over(w)).where("_kind = 1")
    inside = F.col("_at") < F.col("_last")["end"]
    return both.select("_row.*", F.when(inside, F.col("_last")["start"]).alias("sent_start"), F.when(inside, F.col("_last")["end"]).alias("sent_end"))
