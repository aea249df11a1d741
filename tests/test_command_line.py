import json

import pytest

from loomspan.__main__ import VERBS, main

TEXT = "Tove Brandt leads Nordvik Mills. The firm is based in Aalborg."
ANSWER = {
    "entities": [{"id": f"e{k}", "type": t, "name": n, "attributes": {}, "mentions": m} for k, t, n, m in ((1, "Person", "Tove Brandt", ["Tove Brandt"]), (2, "Org", "Nordvik Mills", ["Nordvik Mills", "The firm"]), (3, "Place", "Aalborg", ["Aalborg"]))],
    "relations": [{"type": "EXECUTIVE_OF", "source": "e1", "target": "e2", "modality": "asserted", "evidence": "Tove Brandt leads Nordvik Mills.", "attributes": {}}],
}


@pytest.fixture
def run(spark, capsys):
    def told(*arguments):
        main([str(a) for a in arguments], spark)
        out = capsys.readouterr().out
        return [json.loads(x) for x in out.splitlines()] if out.startswith("{") else out

    return told


def test_from_texts_to_corrected_labels(spark, run, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/a.txt").write_text(TEXT)
    (tmp_path / "texts/b.txt").write_text("Nothing is said.")
    run("ingest", tmp_path / "texts", tmp_path / "chunks")
    chunks = {r.doc_id: r.chunk_id for r in spark.read.json(str(tmp_path / "chunks")).collect()}
    run("prompts", tmp_path / "chunks", tmp_path / "prompts")
    names = {p.name for p in (tmp_path / "prompts").iterdir() if not p.name.startswith((".", "_"))}
    assert names == {f"{c.replace('#', '_')}.json" for c in chunks.values()}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / f"{chunks['a'].replace('#', '_')}.json").write_text(json.dumps(ANSWER))
    counts = run("import", tmp_path / "chunks", tmp_path / "raw", tmp_path / "results")
    assert counts[0]["chunks"] == 2 and counts[0]["missing"] == 1
    gold = {"chunk_id": chunks["a"], "doc_id": "a", "text": TEXT, "gold": ANSWER | {"relations": [*ANSWER["relations"], ANSWER["relations"][0] | {"type": "HEADQUARTERED_IN", "source": "e2", "target": "e3", "evidence": "The firm is based in Aalborg."}]}}
    (tmp_path / "gold.jsonl").write_text(json.dumps(gold) + "\n")
    figures = run("eval", tmp_path / "gold.jsonl", tmp_path / "results", "--by-type")
    strict = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in figures if r.get("metric") == "rel_strict"}
    assert strict == {None: (1, 0, 1), "EXECUTIVE_OF": (1, 0, 0), "HEADQUARTERED_IN": (0, 0, 1)} and figures[-1]["chunks"] == 1
    run("draft", tmp_path / "chunks", tmp_path / "results", tmp_path / "drafts")
    (tmp_path / "said").mkdir()
    (tmp_path / "said/answers_00.txt").write_text(f"## {chunks['a']}\nadd HEADQUARTERED_IN E2 E3\nentity E4 Place: Nowhere\n")
    counts = run("correct", tmp_path / "drafts", tmp_path / "said", tmp_path / "labels")
    assert counts[0]["answered"] == 1 and counts[0]["skipped"] == 1
    assert {r["type"] for r in spark.read.json(str(tmp_path / "labels")).first().relations} == {"EXECUTIVE_OF", "HEADQUARTERED_IN"}


def test_pools_graphs_and_texts(spark, run, tmp_path):
    (tmp_path / "x.jsonl").write_text(json.dumps({"id": "d", "entities": [{"name": "Acme AB", "type": "Org", "mentions": ["Acme", "the firm"]}]}) + "\n")
    run("aliases", tmp_path / "x.jsonl", tmp_path / "aliases")
    assert {(r.name, r.canonical) for r in spark.read.json(str(tmp_path / "aliases")).collect()} == {("acme", "acme"), ("acme ab", "acme")}
    (tmp_path / "g.jsonl").write_text('{"graph": {"id": "ok"}}\n{"graph": {"id": "odd", "x": 1}}\n')
    assert run("check-graphs", tmp_path / "g.jsonl") == [{"doc_id": "odd", "errors": ["graph.x"]}]
    assert "EMPLOYED_BY" in run("schema", "business") and "PLAYS_FOR" in run("brief", "sports") and run("guide")
    assert len(VERBS) >= 14
