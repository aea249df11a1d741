import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import answers as fn_answers
from loomspan.operators import answers, chunk_graph, evaluation, exports, labels, ontology, tagged, targets
from loomspan.operators.schemas import BUSINESS
from loomspan.plans import steps
from loomspan.sources import files, http

from .test_proposers import ANSWER, TEXT


def parsed(spark, *raws, text=TEXT):
    given = spark.createDataFrame([(f"c{k}", text, raw, "sentences", "business") for k, raw in enumerate(raws)], "chunk_id string, text string, raw string, fmt string, schema string")
    return answers.results(given, repair=False)


def figures(df):
    return {r.metric: (r.tp, r.fp, r.fn) for r in df.collect()}


def test_perfect_split_and_missing_answers(spark):
    gold = parsed(spark, ANSWER, ANSWER, ANSWER).cache()
    split = "E1 Person: Tove Brandt\nE2 Org: Nordvik Mills\nE3 Place: Aalborg\nE4 Org: The firm\nS1\nR EMPLOYED_BY E1 E2 asserted\nS2\nR HEADQUARTERED_IN E4 E3 asserted"
    pred = parsed(spark, ANSWER, split).cache()
    got = figures(evaluation.summarized(gold, pred, set(BUSINESS.symmetric())))
    assert got["ent_strict"] == (8, 0, 4) and got["coref"] == (1, 0, 2)
    assert got["rel_strict"] == (3, 1, 3) and got["rel_pair"] == (4, 0, 2) and got["rel_type"] == (3, 1, 1)
    assert got["ent_relaxed"] == (6, 1, 3) and got["rel_relaxed"][0] == 2
    shown = evaluation.summary(gold.select("chunk_id"), pred.withColumn("seconds", F.lit(2.0))).first()
    assert shown.chunks == 3 and shown.schema_validity == 0.6667 and shown.chunks_per_minute == 45.0
    both = evaluation.evaluated(gold.withColumn("schema", F.lit("business")), pred, {"business": BUSINESS}, gold)
    assert {(r.source, r.f1) for r in both.where("metric = 'rel_strict'").collect()} == {("generator", 0.6), ("union", 1.0)}


def test_labels_files(spark):
    res = parsed(spark, ANSWER, ANSWER.replace("EXECUTIVE_OF E1 E2 asserted", "EXECUTIVE_OF E1 E2 hedged"), "garbage")
    texts = spark.createDataFrame([("c0", TEXT)], "chunk_id string, text string")
    got = {r.id: r for r in exports.labels_of(res, texts).collect()}
    assert [tuple(x) for x in got["c0"].relations] == [("Tove Brandt", "EXECUTIVE_OF", "Nordvik Mills"), ("Nordvik Mills", "HEADQUARTERED_IN", "Aalborg")]
    assert got["c0"].text == TEXT and got["c1"].text is None and len(got["c1"].relations) == 1 and got["c2"].entities == [] == got["c2"].relations
    assert len({r.id: r for r in exports.labels_of(res, asserted_only=False).collect()}["c1"].relations) == 2
    gold = res.where("chunk_id = 'c1'").withColumn("text", F.lit(TEXT)).select("chunk_id", "text", F.struct("entities", "relations").alias("gold"))
    assert len(exports.labels_of_gold(gold.unionByName(gold.withColumn("gold", F.lit(None).cast(gold.schema["gold"].dataType)))).first().relations) == 2


def test_pools_prompts_and_drafts(spark, tmp_path):
    items = spark.createDataFrame([("d", "text", [(1, "a", "BORN_IN", "b")])], exports.POOL["items"])
    exports.write_pool({"items": items}, str(tmp_path / "pool"))
    assert exports.read_pool(spark, str(tmp_path / "pool"), "items")["items"].collect() == items.collect()
    with pytest.raises(ValueError):
        exports.write_pool({"other": items}, str(tmp_path / "pool"))
    chunks = spark.createDataFrame([("a#0", TEXT), ("a#1", "Nothing.")], "chunk_id string, text string")
    exports.write_prompts(chunks, str(tmp_path / "prompts"))
    back = {r.file_name: json.loads(r.value) for r in spark.read.format("named_files").load(str(tmp_path / "prompts")).collect()}
    assert set(back) == {"a_0.json", "a_1.json"} and back["a_0.json"]["chunk_id"] == "a#0"
    drafts = parsed(spark, ANSWER, ANSWER).withColumns({"text": F.lit(TEXT), "doc_id": F.lit("d")})
    exports.write_drafts(drafts.select("chunk_id", "doc_id", "text", "entities", "relations"), str(tmp_path / "drafts"), 2, 1)
    batches = spark.read.text(str(tmp_path / "drafts/batches"), wholetext=True).collect()
    assert len(batches) == 2 and all("R1 EXECUTIVE_OF E1 E2" in r.value for r in batches)
    (tmp_path / "said").mkdir()
    (tmp_path / "said/answers_0.txt").write_text("## c0\ndrop R1\nadd MET_WITH E1 E9\n")
    rows, counts = exports.corrected_labels(drafts, exports.answer_files(spark, str(tmp_path / "said")))
    assert [(r.chunk_id, [x.type for x in r.relations]) for r in rows.collect()] == [("c0", ["HEADQUARTERED_IN"])]
    assert counts.first().asDict() == {"answered": 1, "skipped": 1, "left_out": 0, "drafts": 2, "changes": 2}
    spans = drafts.select("chunk_id", "spans")
    own = rows.join(spans, "chunk_id")
    got = {r.source: (r.tp, r.fn) for r in exports.agreement(drafts, drafts, own, set(BUSINESS.symmetric())).collect()}
    assert got == {"draft": (2, 0), "corrected": (1, 1)}


def test_training_examples_under_held_out_types(spark):
    gold = parsed(spark, ANSWER).select(F.struct("entities", "relations").alias("gold"))
    one = gold.select(F.lit("c").alias("chunk_id"), F.lit(TEXT).alias("text"), "gold", F.lit("business").alias("schema"), F.lit(None).cast("array<string>").alias("known"), F.lit(None).cast("string").alias("task"))
    assert exports.training_examples(one).first().messages[-1].content == ANSWER
    held = exports.training_examples(one, held_out={"relations": ["EXECUTIVE_OF"]}).first().messages[-1].content
    assert "EXECUTIVE_OF" not in held and "HEADQUARTERED_IN" in held
    assert exports.training_examples(one, held_out={"schemas": ["business"]}).count() == 0
    assert exports.training_examples(one, variants=True, style="conditioned").count() == 1
    e = answers.entities_of(parsed(spark, ANSWER)).select("chunk_id", "ent_id", "type")
    r = answers.relations_of(parsed(spark, ANSWER)).select("chunk_id", "type", "source", "target")
    es, rs, small = ontology.training_view(e, r, BUSINESS, ["chunk_id"], {"entities": ["Place"]})
    assert {x.type for x in es.collect()} == {"Person", "Org"} and [x.type for x in rs.collect()] == ["EXECUTIVE_OF"] and small.relation("LOCATED_IN") is None
    assert ontology.training_view(e, r, BUSINESS, ["chunk_id"], {"schemas": ["business"]}) is None


def test_stored_results_are_read_again(spark, tmp_path):
    rows = [("c0", "sentences", ANSWER + "\nS1\nR FOUNDED E1 E2 asserted", None, 1.5, "business"), ("c1", "sentences", "old", None, 0.5, None)]
    out = spark.createDataFrame(rows, "chunk_id string, format string, raw string, error string, seconds double, schema string")
    out.write.json(str(tmp_path / "r"))
    stored = files.results(spark, str(tmp_path / "r"))
    texts = spark.createDataFrame([("c0", TEXT)], "chunk_id string, text string")
    got = {r.chunk_id: r for r in files.reread(stored, texts).collect()}
    assert len(got["c0"].relations) == 3 and got["c0"].schema == "business" and got["c1"].relations is None and got["c1"].seconds == 0.5
    assert {r.schema for r in files.reread(stored, schema="sports").collect()} == {"sports"}
    per = spark.createDataFrame([("c0", "nobody's")], "chunk_id string, schema string")
    with pytest.raises(Exception, match="not registered"):
        files.reread(stored, texts, per_chunk=per).collect()
    (tmp_path / "l.jsonl").write_text(json.dumps({"chunk_id": "a", "doc_id": "a", "text": "x", "gold": {"entities": [{"id": "e1", "type": "Ghost", "name": "x", "attributes": {}, "mentions": ["x"]}], "relations": []}}) + "\n\n")
    assert files.checked_labelled(spark, str(tmp_path / "l.jsonl")).first().errors == ["unknown type Ghost"]


def test_result_records_have_all_keys(spark, tmp_path):
    res = parsed(spark, ANSWER, "garbage")
    asked = spark.createDataFrame([("c0", ANSWER, "sentences", 1.5, "business"), ("c1", "garbage", "sentences", None, None)], "chunk_id string, raw string, fmt string, seconds double, schema string")
    files.write_results(files.result_records(res, asked), str(tmp_path / "out"))
    got = {r["chunk_id"]: r for r in (json.loads(x.value) for x in spark.read.text(str(tmp_path / "out")).collect())}
    keys = ["chunk_id", "format", "raw", "error", "seconds", "output", "unresolved_mentions", "unresolved_evidence", "dropped_relations", "illegal_relations", "resolved_spans"]
    assert list(got["c0"]) == [*keys, "schema"] and list(got["c1"]) == keys
    assert got["c0"]["error"] is None and got["c0"]["seconds"] == 1.5 and got["c0"]["schema"] == "business" and got["c0"]["resolved_spans"]["e1"][0] == [0, 11]
    assert got["c1"]["output"] is None and got["c1"]["error"].startswith("sentences:") and got["c1"]["seconds"] == 0.0
    back = {r.chunk_id: r for r in files.reread(files.results(spark, str(tmp_path / "out"))).collect()}
    assert len(back["c0"].entities) == 3 and tuple(back["c0"].spans["e1"][0]) == (0, 11) and back["c1"].entities is None


def test_a_chunk_table_is_asked_in_one_call(spark, tmp_path):
    def ask(prompt):
        if "fails" in prompt:
            raise RuntimeError("no service")
        return ANSWER

    chunks = spark.createDataFrame([("c0", TEXT), ("c1", "This one fails."), ("c2", "Nothing.")], "chunk_id string, text string")
    got = {r.chunk_id: r for r in http.generated(chunks, ask).collect()}
    assert len(got["c0"].output.relations) == 2 and got["c0"].error is None and got["c0"].raw == ANSWER
    assert got["c1"].error == "RuntimeError: no service" and got["c1"].output is None and got["c1"].raw == ""
    assert got["c2"].output.entities == [] and got["c2"].unresolved_mentions > 0


def test_steps_run_once(spark, tmp_path):
    made = []

    def make(done):
        made.append(sorted(done))
        return spark.range(3) if not done else done["a"].where("id > 0")

    for _ in range(2):
        out = steps.run(spark, str(tmp_path), [("a", make), ("b", make)])
    assert made == [[], ["a"]] and out["b"].count() == 2


def test_targets_of_pairs(spark):
    types = BUSINESS.dim_relation_type(spark)
    pairs = spark.createDataFrame([("c", 1, 2), ("c", 1, 3), ("c", 2, 3)], "chunk_id string, a int, b int")
    rel = spark.createDataFrame([("c", "FOUNDED", 2, 1), ("c", "MET_WITH", 3, 1), ("c", "FOUNDED", 2, 2)], "chunk_id string, type string, src int, tgt int")
    got = {(r.a, r.b): [tuple(x) for x in r.labels] for r in targets.gold_targets(pairs, rel, types).collect()}
    assert got == {(1, 2): [("FOUNDED", "<")], (1, 3): [("MET_WITH", ">")], (2, 3): []}
    alignment = spark.createDataFrame([("c", 1, "g2"), ("c", 2, "g1"), ("c", 3, None)], "chunk_id string, pred_ent int, gold_ent string")
    gold = spark.createDataFrame([("c", "FOUNDED", "g2", "g1"), ("c", "MET_WITH", "g1", "g2")], "chunk_id string, type string, src string, tgt string")
    got = {(r.a, r.b): [tuple(x) for x in r.labels] for r in targets.aligned_targets(pairs, gold, alignment, types).collect()}
    assert got == {(1, 2): [("FOUNDED", ">"), ("MET_WITH", ">")], (1, 3): [], (2, 3): []}
    hot = targets.multi_hot(targets.gold_targets(pairs, rel, types), types).where("b = 2 and a = 1").first().target
    assert sum(hot) == 1 and len(hot) == 2 * 21 - 4


def test_tagged_names_join_the_entities(spark):
    tokens = spark.createDataFrame([("c", "Tove met Bo Ek and TOVE.", [(0, 4, "B-Person"), (4, 8, "O"), (8, 11, "B-Person"), (11, 14, "I-Person"), (14, 18, "O"), (18, 23, "B-Person")])], "chunk_id string, text string, tokens array<struct<start: int, end: int, tag: string>>")
    spans = tagged.tagged_spans(tokens)
    assert {(r.start, r.end, r.surface) for r in spans.collect()} == {(0, 4, "Tove"), (9, 14, "Bo Ek"), (19, 23, "TOVE")}
    own = spark.createDataFrame([("c", 4, "Person", "Tove", ["Tove", "she"])], "chunk_id string, n int, type string, name string, mentions array<string>")
    assert [tuple(r)[1:4] for r in tagged.augmented(own, spans).orderBy("n").collect()] == [(4, "Person", "Tove"), (5, "Person", "Bo Ek")]
    gold = tokens.withColumn("entities", F.array(F.struct(F.lit("Person").alias("type"), F.lit("Bo Ek").alias("name"), F.array(F.lit("he")).alias("mentions"))))
    assert tagged.labelled_tokens(gold).first().tags == ["O", "O", "B-Person", "I-Person", "O", "O"]


def chunked(spark):
    """Two chunks of one document, parsed, with scores of pairs."""
    text = TEXT + "\n\nTove Brandt also owns Nordvik Mills. Karup is near."
    chunks = spark.createDataFrame([("d", 0, 0, len(TEXT), TEXT, False), ("d", 1, len(TEXT) + 2, len(text), text[len(TEXT) + 2 :], True)], "doc_id string, chunk int, start int, end int, text string, dense boolean")
    second = "E1 Person: Tove Brandt\nE2 Org: Nordvik Mills\nE3 Org: Karup\nS1\nR OWNS_STAKE_IN E1 E2 asserted"
    given = chunks.withColumns({"raw": F.when(F.col("chunk") == 0, ANSWER).otherwise(second), "fmt": F.lit("sentences"), "schema": F.lit("business"), "chunk_id": F.concat_ws("#", "doc_id", "chunk")})
    res = answers.results(given).join(given.select("chunk_id", "doc_id", "chunk"), "chunk_id")
    keyed = lambda df: df.join(given.select("chunk_id", "doc_id", "chunk"), "chunk_id").drop("chunk_id")
    entities, relations = keyed(answers.entities_of(res.drop("doc_id", "chunk"))), keyed(answers.relations_of(res.drop("doc_id", "chunk")))
    scores = [("d", 0, "EXECUTIVE_OF", 1, 2, 1.239), ("d", 0, "HEADQUARTERED_IN", 2, 3, -1.0), ("d", 0, "EMPLOYED_BY", 1, 2, 0.6), ("d", 1, "OWNS_STAKE_IN", 1, 2, 2.0), ("d", 1, "ACQUIRED", 1, 2, 0.7)]
    return text, chunks, entities, relations, spark.createDataFrame(scores, "doc_id string, chunk int, type string, src int, tgt int, margin double")


def test_chunk_graphs_by_the_union_rule(spark):
    _, chunks, entities, relations, scores = chunked(spark)
    g = chunk_graph.combined(chunks, entities, relations, scores, BUSINESS, dense_margin=1.0)
    got = {(r.chunk, r.type, r.origin, r.score, r.sent_start) for r in g.relations.collect()}
    # a written one below the cut goes, a scored one over the margin comes in, but not in a dense chunk with a higher margin
    assert got == {(0, "EXECUTIVE_OF", "generator", 1.24, 0), (0, "EMPLOYED_BY", "head", 0.6, None), (1, "OWNS_STAKE_IN", "generator", 2.0, len(TEXT) + 2)}
    assert {(r.mention, r.at) for r in g.mentions.where("chunk = 1").collect()} == {("Tove Brandt", 64), ("Nordvik Mills", 86), ("Karup", 101)} and g.warnings.count() == 0
    small = chunk_graph.combined(chunks, entities, relations, scores, BUSINESS, settings=chunk_graph.EngineConfig(max_entities=3, max_relations=2))
    assert {r.chunk for r in small.warnings.collect()} == {0, 1} and small.warnings.count() == 3


def test_unlinked_entities_are_tried_as_other_types(spark):
    _, chunks, entities, relations, scores = chunked(spark)

    def rescore(own, kept):
        assert {r.n for r in own.where("chunk = 1").collect()} == {1, 2, 3} and kept.count() > 0
        rows = [("d", 1, 3, "Place", "HEADQUARTERED_IN", 2, 3, 3.0), ("d", 1, 3, "Person", "EMPLOYED_BY", 3, 2, 1.0), ("d", 1, 3, "Place", "BORN_IN", 2, 3, 9.0)]
        return spark.createDataFrame(rows, "doc_id string, chunk int, n int, as_type string, type string, src int, tgt int, margin double")

    g = chunk_graph.combined(chunks, entities, relations, scores, BUSINESS, rescore)
    assert {r.type for r in g.entities.where("chunk = 1 and ent_id = 'e3'").collect()} == {"Place"}
    assert ("HEADQUARTERED_IN", "head") in {(r.type, r.origin) for r in g.relations.where("chunk = 1").collect()}
    lone = [(k, "Person") for k in range(1, 8)]
    margins = [{"n": k, "as_type": "Org", "type": "SUBSIDIARY_OF", "src": k, "tgt": 9, "margin": 2.0} for k in range(1, 8)]
    changed, added = chunk_graph.retested([*lone, (9, "Org")], [("FOUNDED", 9, 99)], margins, BUSINESS, 0.5, 4, 400)
    assert changed == {k: "Org" for k in range(1, 5)} and len(added) == 4


def test_documents_from_chunk_graphs(spark):
    text, chunks, entities, relations, scores = chunked(spark)
    g = chunk_graph.combined(chunks, entities, relations, scores, BUSINESS)
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    from loomspan.operators import segmentation

    m = chunk_graph.merged(g, docs, chunks, segmentation.sentences(docs), BUSINESS.symmetric())
    assert {(r.ent_id, r.name) for r in m.entities.collect()} == {("e1", "Tove Brandt"), ("e2", "Nordvik Mills"), ("e3", "Aalborg"), ("e4", "Karup")}
    kinds = {r.type: r for r in m.relations.collect()}
    assert set(kinds) == {"EXECUTIVE_OF", "EMPLOYED_BY", "OWNS_STAKE_IN", "ACQUIRED"}
    where = {(r.type, r.chunk): text[r.sent_start : r.sent_end] for r in m.evidence.collect()}
    assert where["EMPLOYED_BY", 0] == "Tove Brandt leads Nordvik Mills." and where["ACQUIRED", 1] == "Tove Brandt also owns Nordvik Mills."
    rows = exports.labels_of_graphs(m.entities, m.relations, m.occurrences, docs).first()
    assert rows.entities[0].mentions == ["Tove Brandt"] and ("Tove Brandt", "OWNS_STAKE_IN", "Nordvik Mills") in {tuple(x) for x in rows.relations}


def test_drafts_are_read_as_they_are_written():
    found = fn_answers.decode("sentences", ANSWER, TEXT)[0]
    draft = exports.draft_text("c", TEXT, found["entities"], found["relations"])
    assert draft.startswith("## c\nE1 Person: Tove Brandt\n")
