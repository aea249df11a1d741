"""How often what queries are made of is dealt out or worked out."""

import pytest
from pyspark.sql import functions as F

from loomspan.operators import decoding, evaluation
from loomspan.plans import answer_queries, score_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_of_an_evaluation_are_dealt_out_by_chunk_alone(spark):
    plan = plan_of(score_queries.evaluation_figures(spark, "/root/testdata/sf0.001"))
    by_chunk = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "metric" not in line]
    assert len(by_chunk) == 2 and all("hashpartitioning(chunk_id" in line and "REPARTITION_BY_COL" in line for line in by_chunk)
    assert "ObjectHashAggregate" not in plan


def test_a_source_that_answers_nothing_counts_as_empty(spark):
    side = "array<struct<id: string, type: string, mentions: array<string>>>"
    schema = f"chunk_id long, {{}} string, entities {side}, relations array<struct<type: string, source: string, target: string>>, spans map<string, array<struct<start: int, end: int>>>"
    es, spans = [("a", "Org", ["Nordvik Mills", "the Mills"]), ("b", "Org", ["Moss"])], {"a": [(9, 12), (0, 3)], "b": [(20, 24)]}
    gold = spark.createDataFrame([(1, "s", es, [("O", "b", "a")], spans)], schema.format("schema"))
    said = spark.createDataFrame([(1, "one", es[::-1], [("O", "a", "b"), ("P", "a", "z")], spans), (2, "one", es, [], spans)], schema.format("source"))
    got = {(r.source, r.metric, r.type): (r.tp, r.fp, r.fn) for r in evaluation.figures(gold, said, {"s": ["O"]}, True, ["one", "two"]).collect()}
    assert got["one", "ent_strict", None] == (3, 0, 0) and got["one", "coref", None] == (1, 0, 0) and got["one", "ent_relaxed", None] == (2, 0, 0)
    assert got["one", "rel_strict", None] == (1, 1, 0) and got["one", "rel_strict", "P"] == (0, 1, 0) and got["one", "rel_pair", None] == (1, 1, 0)
    assert got["two", "ent_strict", None] == (0, 0, 3) and got["two", "rel_strict", "O"] == (0, 0, 1) and got["two", "coref", None] == (0, 0, 1)
    alone = {r.source for r in evaluation.figures(gold, said, {"s": ["O"]}).collect()}
    assert alone == {"one"}


@pytest.mark.parametrize("name", ["lenient_counts", "lenient_relations", "schema_violations"])
def test_rules_read_answers_that_were_decoded_once(spark, name):
    plan = plan_of(getattr(answer_queries, name)(spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in plan.lower() and "regexp" not in plan.lower() and "rlike" not in plan.lower()


def test_a_line_is_hashed_once(spark):
    plan = answer_queries.answers_of(spark.createDataFrame([(1, "Some Text")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_white_space_of_all_kinds_goes_and_stays_within(spark):
    given = ["", " ", "a", " a", "a\n", "\u00a0a b\u2003", "\x1ca\u0085", "a \t b", "\u3000", None]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, t string").select("k", decoding.stripped(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == ["", "", "a", "a", "a", "a b", "a", "a \t b", "", None]


def test_lines_without_names_are_malformed(spark):
    raws = ["E1 Person: |\nE1 Person: Tove | Tove |\nE2 Org:  | \u00a0|", "E3 Org: x"]
    none = spark.createDataFrame([], "chunk_id long, k int, text string")
    got = decoding.decoded(spark.createDataFrame(list(enumerate(raws)), "chunk_id long, raw string"), none)
    assert sorted((r.chunk_id, r.ord, r.ent_id, r.name, r.mentions) for r in got.entities.collect()) == [(0, 1, "e1", "Tove", ["Tove"]), (1, 0, "e3", "x", ["x"])]
    assert {r.chunk_id: (r.n_entities, r.malformed) for r in got.outcomes.collect()} == {0: (1, 2), 1: (1, 0)}
