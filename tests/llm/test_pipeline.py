import pytest

import corpus_pipeline
from loomspan.llm import decontaminate, mixing, neardup, quality
from loomspan.llm.common import table

from .helpers import SF, empty, has_data, odd


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), path).count() == 0, name
        out = stage(spark, odd(spark), path)
        out.collect()
        if name != "sharding":
            assert out.columns == odd(spark).columns


@pytest.mark.skipif(not has_data(), reason="no test tables")
def test_run_equals_the_stages_by_hand(spark):
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    rows = docs.where(docs.doc_id.isin(list(good)))
    first = {r.doc_id for r in neardup.near_duplicates(rows).collect() if r.kept}
    rows = rows.where(rows.doc_id.isin(list(first)))
    leaked = {r.doc_id for r in decontaminate.decontaminate(rows, table(spark, SF, "benchmark")).collect() if r.contaminated}
    rows = rows.where(~rows.doc_id.isin(list(leaked)))
    copies = {r.doc_id: round(r.taken / r["size"] + 1e-12) for r in mixing.mix(rows).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) == sum(copies.values()) and {r.doc_id for r in out} == {i for i, n in copies.items() if n}
