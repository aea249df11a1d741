"""Steps that can be taken up again: one whose result is there isn't run a second time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end under the path."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under the path; where it isn't finished, it is made and written first, over what a broken run left."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, folder: str, steps: list[tuple[str, Callable[..., DataFrame]]]) -> dict[str, DataFrame]:
    """Named steps in turn, each written under the folder; a step is called with the tables of all steps before it, by name."""
    done: dict[str, DataFrame] = {}
    for name, make in steps:
        own = dict(done)
        done[name] = once(spark, f"{folder}/{name}", lambda make=make, own=own: make(own))
    return done
