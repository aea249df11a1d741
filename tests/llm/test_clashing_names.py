import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import decontaminate, infilling, language, mixing, neardup, pii, quality, secrets, sharding, suffixes, tokens

from .helpers import docs, odd

#: Names that operators give to columns of their own somewhere.
NAMES = """row row_key copies copy md5 digest block kept distance group_id least node doc shard part virtual_slot h run rank words n_words
g_lang g_source start l s n at bin name key keys gone again id _id _md5 _digest _row_key _copies _copy bucket names text_crc32 spans share items""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    return odd(spark).select("doc_id", "text", "lang", "source", *(F.lit(k).alias(name) for k, name in enumerate(NAMES)))


def test_operators_ignore_extra_columns(spark, clashing):
    n = clashing.count()
    for apply in (mixing.mix, pii.find_pii, secrets.find_secrets, quality.judge, neardup.near_duplicates, tokens.count_tokens, language.identify, sharding.shard, suffixes.remove_repeats, infilling.fill_in_middle):
        assert len(apply(clashing).collect()) == n, apply.__module__
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert len(decontaminate.decontaminate(clashing, bench).collect()) == n


def test_stages_pass_extra_columns_through(spark, clashing, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, path)
        rows = out.collect()
        assert out.columns == clashing.columns, name
        assert all(r[c] == k for r in rows for k, c in enumerate(NAMES)), name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, path).count() == clashing.count()


def test_null_keys_fare_like_others(spark):
    """Language null with source x, and language x with source null: other groups, and rows of their own."""
    text = " ".join(f"w{k}" for k in range(60))
    d = docs(spark, [text, text, text], lang=["x", None, None], source=[None, "x", None])
    assert quality.keep_good(d).count() == 3
    taken = mixing.mix(d).select("row_key").distinct().count()
    assert taken == 3
