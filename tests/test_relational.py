"""Decoding and checking as relations, against the functions that do the same for one text."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import answers, segment, validate
from loomspan.operators import checking, decoding
from loomspan.operators.ontology import Schema
from loomspan.operators.schemas import BUSINESS, LEGAL

TEXT = "Ann met Bob. Bob owns Acme! Acme is in Rome.\n| a | b |\nLast one"
KINDS = ["Person", "Org", "Place", "Event", "Thing", "Case", "Charge"]
EDGES = ["EMPLOYED_BY", "LOCATED_IN", "FAMILY_OF", "HELD_AT", "FOUNDED", "LIKES", "HEARD_BY", "CHARGED_WITH"]


def said(rng, lines, fmt):
    """An answer with everything that goes wrong in answers."""
    out = []
    for _ in range(lines):
        n, m = rng.randint(1, 60 if lines > 60 else 8), rng.randint(1, 9)
        more = rng.choice(["", " date=1999", " a=1; a=2;b = 3 ;=x;y=;noise", "  ", " key=v=w"])
        where = f" S{rng.randint(0, 7)}" if fmt == "lines" else ""
        out.append(
            rng.choice(
                [
                    f"E{n} {rng.choice(KINDS)}: {rng.choice(['Ann | the boss | Ann', 'the company', 'Élan| ÉLAN SA |x', ' | ', '| |Acme', 'a|b|' * 20])}",
                    f"  R {rng.choice(EDGES)} E{n} E{m} {rng.choice(['asserted', 'hedged', 'maybe'])}{where}{more}\t",
                    f"R {rng.choice(EDGES)} E{m} E{n} asserted{where}",
                    f"S{rng.randint(0, 7)}",
                    rng.choice(["", "   ", "noise", "R broken", "E1 Person:", "S99999999999999999999", "Sx", "E٣ Person: Ann", "R LIKES E1 E2"]),
                ]
            )
        )
    return rng.choice(["\n", "\r\n", "\n"]).join(out)


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(11)
    own = {fmt: {k: said(rng, rng.choice([0, 1, 3, 12, 30, 200]), fmt) for k in range(120)} | {900: None, 901: "", 902: "only\nnoise"} for fmt in ("sentences", "lines")}
    numbered = segment.numbered_sentences(TEXT)
    keys = list(own["lines"])
    sentences = spark.createDataFrame([(k, i, TEXT[a:b]) for k in [*keys, 5000] for i, (a, b) in enumerate(numbered)], "chunk_id long, k int, text string")
    return own, sentences


@pytest.mark.parametrize("fmt", ["sentences", "lines"])
def test_decoding_equals_the_function(spark, given, fmt):
    own, sentences = given
    df = spark.createDataFrame(list(own[fmt].items()), "chunk_id long, raw string")
    got = decoding.decoded(df, sentences, fmt)
    entities, relations = {}, {}
    for r in got.entities.orderBy("ord").collect():
        entities.setdefault(r.chunk_id, []).append({"id": r.ent_id, "type": r.type, "name": r.name, "attributes": {}, "mentions": r.mentions})
    for r in got.relations.orderBy("ord").collect():
        relations.setdefault(r.chunk_id, []).append({"type": r.type, "source": r.source, "target": r.target, "modality": r.modality, "evidence": r.evidence, "attributes": r.attributes})
    outcomes = {r.chunk_id: r for r in got.outcomes.collect()}
    assert outcomes.keys() == own[fmt].keys() and outcomes[900].error == "no answer"
    for k, raw in own[fmt].items():
        found, wrong = answers.decode(fmt, raw or "", TEXT)
        assert outcomes[k].error == wrong or k == 900
        found = found or {"entities": [], "relations": []}
        assert sorted(entities.get(k, []), key=str) == sorted(found["entities"], key=str), raw
        assert relations.get(k, []) == found["relations"], raw
        assert (outcomes[k].n_entities, outcomes[k].n_relations) == (len(found["entities"]), len(found["relations"]))


def test_one_shuffle_of_answers_and_no_python(spark, given):
    own, sentences = given
    df = spark.createDataFrame(list(own["lines"].items()), "chunk_id long, raw string")
    got = decoding.decoded(df, sentences, "lines")
    for part, exchanges in ((got.entities, 1), (got.outcomes, 1), (got.relations, 2)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= exchanges and "Python" not in plan and "InArrow" not in plan


def plain_repeats(raw):
    """The rule as it is told: a repeat is the last line of its block."""
    known, out, stopped = [], [], False
    for line in raw.split("\n"):
        if line[:1] == "S":
            stopped = False
        if stopped:
            continue
        out.append(line)
        if line[:2] == "R ":
            triple = line.split()[1:4]
            stopped = triple in known
            known.append(triple)
    return "\n".join(out)


def test_repeats_end_a_block(spark, given):
    fixed = "E1 Person: A\nS1\nR MET_WITH E1 E2 asserted\nS2\nR MET_WITH E1 E2 asserted\nR broken\nfoo\nR MET_WITH E1 E3 asserted\nS3\nR MET_WITH E1 E3 asserted"
    rows = [(k, (raw or "").replace("\n  R", "\nR")) for k, raw in given[0]["sentences"].items()] + [(7000, fixed), (7001, None)]
    got = {r.k: r.out for r in spark.createDataFrame(rows, "k long, raw string").select("k", decoding.without_repeats(F.col("raw")).alias("out")).collect()}
    assert got[7000] == "E1 Person: A\nS1\nR MET_WITH E1 E2 asserted\nS2\nR MET_WITH E1 E2 asserted\nS3\nR MET_WITH E1 E3 asserted"
    assert got[7001] is None
    for k, raw in rows[:-1]:
        assert got[k] == plain_repeats(raw)
        assert answers.drop_repeats(raw) == plain_repeats(raw)


@pytest.mark.parametrize(("repair", "retype"), [(True, True), (False, True), (True, False)])
def test_checking_equals_the_functions(spark, given, repair, retype):
    own, sentences = given
    df = spark.createDataFrame([(k, raw) for k, raw in own["sentences"].items() if raw], "chunk_id long, raw string")
    got = decoding.decoded(df, sentences)
    schemas: list[Schema] = [BUSINESS, LEGAL]
    schema_of = spark.createDataFrame([(k, schemas[k % 2].name) for k in own["sentences"]], "chunk_id long, schema string")
    rules = checking.Rules.of(spark, schemas)
    out = checking.lenient(got.entities, got.relations, schema_of, rules, repair, retype)
    entities, relations, broken = {}, {}, {}
    for r in out.entities.orderBy("ord").collect():
        entities.setdefault(r.chunk_id, {})[r.ent_id] = r.type
    for r in out.relations.orderBy("ord").collect():
        relations.setdefault(r.chunk_id, []).append((r.type, r.source, r.target, r.modality, r.evidence, r.attributes))
    for r in checking.violations(got.entities, got.relations, schema_of, rules).collect():
        broken.setdefault(r.chunk_id, []).append(r)
    counts = {r.chunk_id: r for r in out.counts.collect()}
    assert counts.keys() == own["sentences"].keys()
    retyped = 0
    for k, raw in own["sentences"].items():
        found = answers.decode("sentences", raw or "", TEXT)[0] or {"entities": [], "relations": []}
        want = validate.lenient(found, schemas[k % 2], repair, retype)
        assert entities.get(k, {}) == {e["id"]: e["type"] for e in want.entities}
        assert relations.get(k, []) == [(r["type"], r["source"], r["target"], r["modality"], r["evidence"], r["attributes"]) for r in want.relations]
        c = counts[k]
        assert (c.unknown_types, c.retyped, c.dropped, c.illegal, c.repaired) == (want.unknown_types, want.retyped_entities, want.dropped_relations, want.illegal_relations, want.repaired_relations)
        retyped += want.retyped_entities
        errors = validate.strict_errors(found["entities"], found["relations"], schemas[k % 2])
        assert bool(errors) == (k in broken)
    assert retyped or not retype


def test_ids_that_come_twice(spark):
    entities = spark.createDataFrame([(1, 0, "e1", "Person"), (1, 1, "e1", "Org"), (1, 2, "e2", "Org"), (2, 0, "e1", "Thing"), (2, 1, "e1", "Org"), (3, 0, "e1", "Org")], "chunk_id long, ord int, ent_id string, type string")
    relations = spark.createDataFrame([(1, 0, "EMPLOYED_BY", "e1", "e2", "asserted", {"role": "x", "kind": "y"})], "chunk_id long, ord int, type string, source string, target string, modality string, attributes map<string, string>")
    schema_of = spark.createDataFrame([(k, "business") for k in (1, 2, 3, 4)], "chunk_id long, schema string")
    rules = checking.Rules.of(spark, [BUSINESS])
    out = checking.lenient(entities, relations, schema_of, rules)
    assert {r.chunk_id: r.error for r in out.counts.collect()} == {1: "duplicate entity ids", 2: None, 3: None, 4: None}
    assert sorted((r.chunk_id, r.ent_id) for r in out.entities.collect()) == [(2, "e1"), (3, "e1")]
    assert out.relations.count() == 0
    assert sorted((r.chunk_id, r.rule, r.what, r.n) for r in checking.violations(entities, relations, schema_of, rules).collect()) == [
        (1, "id_twice", "e1", 2),
        (1, "illegal_ends", "EMPLOYED_BY Org Org", 1),
        (2, "id_twice", "e1", 2),
        (2, "unknown_type", "Thing", 1),
    ]
