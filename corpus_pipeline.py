"""A corpus from documents to shards: quality rules, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it left; all but the last return the columns
of docs. The hashes and the models of these stages have no equivalent in SQL; tests compare them with plainer versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import decontaminate, mixing, neardup, quality, sharding
from loomspan.llm.common import mark, release, remove_since, stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go.

    Null, empty and short texts fail the base rules; very long ones are counted whole; rows that are alike fare alike; a null
    language or source is a group of its own; extra columns pass through, whatever they are called; an empty table gives none.
    """
    return quality.keep_good(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays.

    The least id of a group stays, and one row of an id that repeats; a text without words is a copy of equal ones
    alone; rows with a null id all stay; extra columns pass through; an empty table gives none.
    """
    return neardup.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none; long ones are searched whole; repeated rows fare alike; an empty benchmark keeps all
    rows; extra columns pass through; an empty table gives none.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Rows without words are taken 0 times and go; a null source is a source; rows that are alike share their copies evenly;
    extra columns pass through; an empty table gives none.
    """
    return mixing.repeat_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: a row for each copy, with its shard and place.

    Null ids and texts are records like others; copies of a record get places of their own, in any order; extra columns
    are left out; an empty table gives none.
    """
    return sharding.shard(docs)


STAGES = [("quality", good), ("neardup", unlike), ("decontaminate", clean), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each writes its rows to the shared folder, and what it wrote on the way is removed."""
    docs = table(spark, sf_dir, "documents")
    at = mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            remove_since(spark, at, docs)
            release(spark)
    return docs
