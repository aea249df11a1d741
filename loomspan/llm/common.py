"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, and the word itself, as Java patterns.
GAP, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: The same white space as a set of characters.
BLANKS = " \t\n\x0b\x0c\r"
#: Catalyst gives this many bytes or more to what it knows no size of.
UNKNOWN = 1 << 60
#: Rows of a table that may be broadcast: of ids, 3 MB.
SMALL = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, as in tests, a temporary one of this machine is taken; a local master alone may do that."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomspan-"))
    return sc.getCheckpointDir()


#: After so many tables cut, the driver lets go of what nothing refers to.
TIDY = 4
_cuts = 0


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there, so that lost executors cost no recomputation."""
    global _cuts
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()
    _cuts += 1
    if _cuts % TIDY == 0:
        release(spark)
    return done


#: Folders that stored() has written and nobody has removed yet.
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def mark() -> int:
    """A place among the folders written so far, for remove_since."""
    return len(_written)


def remove_since(spark: SparkSession, at: int, keep: DataFrame | None = None) -> None:
    """Removes the folders written since a mark, but for the one that keep reads: for steps whose result is written elsewhere by now."""
    own = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in keep.inputFiles()} if keep is not None else set()
    left = []
    for path in _written[at:]:
        if path.split(":", 1)[-1].lstrip("/") in own:
            left.append(path)
        else:
            files, where = _files(spark, path)
            files.delete(where, True)
    _written[at:] = left


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver next collects garbage.

    Then the driver's JVM gives back what its native allocator holds free: Spark's many short-lived threads leave that scattered over
    dozens of arenas. JVMs without that command keep it.
    """
    gc.collect()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    by_name = jvm.java.lang.Class.forName
    try:
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        given = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0))
        signature, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for k in range(4):
            signature[k], values[k] = by_name(kinds[k]), given[k]
        by_name("javax.management.MBeanServer").getMethod("invoke", signature).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        pass


def whole(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def scaled(df: DataFrame, mb: int = 32, least: int = 8) -> int:
    """A number of partitions that follows the size of what a plan reads: one for each mb of its scans, added up and never multiplied
    as estimates of joins are. Where a scan has no known size, as a table made in memory, it is the session's number of shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    if any(x >= UNKNOWN for x in sizes):
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(200_000, sum(sizes) // (mb << 20)))


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """The table with a hint to broadcast it if it is counted to have so many rows at most; else as it is, for a join by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def null_safe(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def fingerprint(*columns: Column) -> Column:
    """128 bits of several values, in which null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x01", *(F.md5(p) for p in parts)))
