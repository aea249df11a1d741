"""JSON that is looked at as VARIANT: graphs, and answers of proposers."""

import json
import random

import pytest

from loomspan.functions import answers, validate
from loomspan.operators import checking, decoding
from loomspan.operators.schemas import BUSINESS
from loomspan.sources import graph

GRAPH = {"graph": {"id": "g", "label": "g", "directed": True, "type": "t", "metadata": {}, "nodes": {"a": {"label": "A", "metadata": {}}, "b": {"label": "B"}}, "edges": [{"id": "r0", "source": "a", "target": "b", "relation": "X"}]}}


def changed(change):
    g = json.loads(json.dumps(GRAPH))
    change(g["graph"])
    return json.dumps(g)


CASES = {
    json.dumps(GRAPH): [],
    changed(lambda g: g.update(extra=1, more=2)): ["graph.extra", "graph.more"],
    changed(lambda g: g["nodes"]["a"].update(x=1)): ["node a.x"],
    changed(lambda g: g["edges"][0].update(x=None, y={})): ["edge r0.x", "edge r0.y"],
    changed(lambda g: g["edges"].append({"source": "q", "target": "b"})): ["edge None: no node q"],
    changed(lambda g: g["edges"].append({"id": "r1"})): ["edge r1: no node None", "edge r1: no node None"],
    changed(lambda g: g["edges"].append(3)): ["edge None.no object"],
    changed(lambda g: g.update(nodes=[])): ["nodes is no object or edges no array"],
    changed(lambda g: g.pop("nodes")): ["edge r0: no node a", "edge r0: no node b"],
    changed(lambda g: (g.pop("nodes"), g.pop("edges"))): [],
    "": ["no graph object"],
    "{": ["no graph object"],
    "[1]": ["no graph object"],
    '{"graph": 3}': ["no graph object"],
    '{"graph": {"id": "a", "id": "b"}}': ["no graph object"],
}


def test_graphs(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([*CASES, None])], "doc_id long, value string")
    found = graph.graph_errors(df)
    assert "Python" not in (plan := found._jdf.queryExecution().toString()) and "InArrow" not in plan
    got = {r.doc_id: r.errors for r in found.collect()}
    assert [got[k] for k in range(len(CASES))] == list(CASES.values()) and got[len(CASES)] == ["no graph object"]


def said(rng):
    """An answer in JSON, sound or not."""
    pick = rng.choice
    entity = lambda k: {"id": f"e{k}", "type": pick(["Person", "Org", "Thing"]), "name": "N", "mentions": pick([["N"], ["N", "M"]])} | pick([{}, {}, {"attributes": {"a": "b"}}])
    relation = lambda: {"type": pick(["EMPLOYED_BY", "LIKES"]), "source": f"e{rng.randint(0, 4)}", "target": f"e{rng.randint(0, 4)}", "evidence": "x"} | pick([{}, {"modality": "hedged"}, {"modality": "perhaps"}, {"attributes": {"role": "r", "n": "1"}}])
    doc = {"entities": [entity(k) for k in range(rng.randint(0, 5))], "relations": [relation() for _ in range(rng.randint(0, 5))]}
    fault = rng.random()
    if fault < 0.1 and doc["entities"]:
        doc["entities"][0].pop(pick(["id", "type", "name", "mentions"]))
    elif fault < 0.15 and doc["entities"]:
        doc["entities"][0]["mentions"] = pick([[], ["a"] * 13, [1], "N"])
    elif fault < 0.2:
        doc["entities"] = [entity(k) for k in range(41)]
    elif fault < 0.25:
        doc.pop(pick(["entities", "relations"]))
    elif fault < 0.3 and doc["relations"]:
        doc["relations"][0].pop(pick(["type", "source", "evidence"]))
    return pick(["{}", "```json\n{}\n```", "So: {} done", "```\n{}```"]).replace("{}", json.dumps(doc, ensure_ascii=pick([True, False])))


@pytest.fixture(scope="module")
def raws():
    rng = random.Random(3)
    return dict(enumerate([None, "", "no object", "{", '{"entities": 3}', '{"entities": []}', "{} {}", '}{"a": 1'] + [said(rng) for _ in range(300)]))


def test_answers_in_json(spark, raws):
    got = decoding.decoded_json(spark.createDataFrame(list(raws.items()), "chunk_id long, raw string"))
    schema_of = spark.createDataFrame([(k, "business") for k in raws], "chunk_id long, schema string")
    kept = checking.lenient(got.entities.drop("name", "mentions"), got.relations.where("evidence is not null"), schema_of, checking.Rules.of(spark, [BUSINESS]))
    outcomes = {r.chunk_id: r for r in got.outcomes.collect()}
    entities, relations = {}, {}
    for r in kept.entities.orderBy("ord").collect():
        entities.setdefault(r.chunk_id, []).append((r.ent_id, r.type))
    for r in kept.relations.orderBy("ord").collect():
        relations.setdefault(r.chunk_id, []).append((r.type, r.source, r.target, r.modality, r.attributes))
    for k, raw in raws.items():
        found, wrong = answers.decode("json", raw or "", "")
        want = validate.lenient(found, BUSINESS) if found is not None else validate.Result(error=wrong)
        error = outcomes[k].error
        assert (error is None) == (want.error is None), (raw, error, want.error)
        assert error == want.error or error in ("no answer", "json: malformed")
        assert entities.get(k, []) == [(e["id"], e["type"]) for e in want.entities], raw
        assert relations.get(k, []) == [(r["type"], r["source"], r["target"], r["modality"], r["attributes"]) for r in want.relations], raw
