"""flat_map holds a few rows' results at once."""

from pyspark.sql import functions as F

from loomspan.operators.rows import flat_map


def test_memory_does_not_grow_with_the_batch(spark):
    """5,000 rows of one batch make 3 million strings; all at once would be over 500 MB."""

    def make(_):
        held = int(open("/proc/self/statm").read().split()[1]) // 256
        for k in range(600):
            yield f"a string of row number {k}, which is not short", held

    made = flat_map(spark.range(5000).coalesce(1), ["id"], ["id"], make, "s string, mb long")
    r = made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), (F.max("mb") - F.min("mb")).alias("grown")).first()
    assert (r.n, r.ids) == (3_000_000, 5000)
    assert r.grown < 250
