import pytest
from pyspark.sql import functions as F

from loomspan.llm import tokens
from loomspan.llm.common import fingerprint, scaled, small, table

from .helpers import SF, docs, has_data


def test_partitions_of_a_table_in_memory_follow_the_session(spark):
    assert scaled(docs(spark, ["a", "b"])) == 8
    counted = tokens.count_tokens(docs(spark, ["a b c", "d"]))
    assert sorted(r.n_tokens for r in counted.collect()) == [1, 3]


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_partitions_after_joins_add_the_scans_up(spark):
    d = table(spark, SF, "documents")
    joined = d
    for k in range(4):
        joined = joined.join(d.select("doc_id", F.lit(k).alias(f"k{k}")), "doc_id")
    assert scaled(d) == 8 and scaled(joined) == 8
    assert scaled(joined, mb=1, least=1) < 64


def test_blocks_are_dealt_to_all_buckets():
    for buckets in (8, 64, 211):
        dealt = {tokens.block_bucket((part << 32) + n, buckets) for part in range(100) for n in range(3)}
        assert len(dealt) > 0.7 * min(buckets, 300)


def test_small_tables_alone_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(small(spark.range(5), 5)) and "broadcast" not in plan(small(spark.range(6), 5))


def test_fingerprints_tell_nulls_apart(spark):
    rows = [(None, "x"), ("x", None), ("", "x"), ("-", "x"), ("x", "-"), (None, None), ("x", "x")]
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprint(F.col("a"), F.col("b")).alias("f"))
    assert df.distinct().count() == len(rows)
