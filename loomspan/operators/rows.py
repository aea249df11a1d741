"""Helpers of operators: a function from a row's values to rows over Arrow batches, ranks without a global sort, and tables written down."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows whose values and results Python holds as objects at once.
ROWS = 128


def flat_map(df: DataFrame, keys: list[str], inputs: list[str], make: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Each row's keys beside every tuple that make(*inputs) gives for it. Only keys and inputs are read; no shuffle. Python holds ROWS rows and what is made of them at once, however many a batch has."""
    fields = T._parse_datatype_string(schema).fields
    out = T.StructType([df.schema[k] for k in keys] + fields)
    arrow = to_arrow_schema(out)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            given = [batch.column(n + k).to_pylist() for k in range(len(inputs))]
            columns: list[list] = [[] for _ in fields]
            at: list[int] = []
            for row, values in enumerate(zip(*given, strict=True)):
                for made in make(*values):
                    at.append(row)
                    for column, x in zip(columns, made, strict=True):
                        column.append(x)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            own += [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[n:], strict=True)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(own, arrow, strict=True)], schema=arrow)

    return df.select(*keys, *(df[i].alias(f"_in{k}") for k, i in enumerate(inputs))).mapInArrow(run, out)


def ranked(df: DataFrame, h: Column, *order: str, name: str = "_rank") -> DataFrame:
    """Adds a rank from 1 in the order of h, a number below 2^32 that spreads evenly, then of the columns: windows over 4,096 parts of its range, and one over their sizes."""
    placed = df.withColumn("_h", h).withColumn("_part", F.shiftright("_h", 20))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_before"))
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy("_part").orderBy("_h", *order)))
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_h", "_part", "_own", "_before")  # 4,096 rows at most


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder in spark.checkpoint.dir and read from there by all that use them. Where none is set, a local master takes a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomspan-"))
    return df.checkpoint()


#: Rows of a table that may be broadcast.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """A table that was written down, with a hint to broadcast it if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
