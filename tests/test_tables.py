import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from loomspan.operators.rows import written
from loomspan.operators import answers, evaluation, judging, labels, ontology, resolution, segmentation, union
from loomspan.operators.schemas import BUSINESS
from loomspan.sources import files, graph, http
from loomspan.streaming import carry

from .test_text import RAW, TEXT


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_chunks_and_sentences_of_odd_rows(spark):
    docs = spark.createDataFrame([("a", "One. Two.\nThree."), ("b", None), ("c", ""), ("d", "𝒳 one. Two 🦊 three.")], "doc_id string, text string")
    own = segmentation.chunks(docs).join(docs.withColumnRenamed("text", "all"), "doc_id")
    assert own.where("substring(all, start + 1, end - start) != text").count() == 0 and {r.doc_id for r in own.collect()} == {"a", "d"}
    mentions = spark.createDataFrame([("a", 5), ("a", 4), ("a", 12), ("z", 1)], "doc_id string, start int")
    got = {(r.doc_id, r.start): (r.sent_start, r.sent_end) for r in segmentation.with_sentence(mentions, segmentation.sentences(docs), ["doc_id"]).collect()}
    assert got == {("a", 5): (5, 9), ("a", 4): (None, None), ("a", 12): (10, 16), ("z", 1): (None, None)}


def test_answers_to_results(spark):
    given = spark.createDataFrame([("c1", TEXT, RAW, "sentences", "business"), ("c2", TEXT, None, None, None), ("c3", TEXT, "garbage", "lines", None)], "chunk_id string, text string, raw string, fmt string, schema string")
    out = answers.results(given).cache()
    got = {r.chunk_id: r for r in out.collect()}
    assert len(got["c1"].relations) == 3 and got["c2"].error == "no answer" and got["c3"].error.startswith("lines: no parseable")
    assert answers.entities_of(out).count() == 4 and answers.relations_of(out).count() == 3
    said = answers.encoded(out.join(given.select("chunk_id", "text"), "chunk_id"), "sentences").where("chunk_id = 'c1'").first().answer
    assert said == RAW
    assert labels.import_counts(out).first().missing == 1


def test_union_rule(spark):
    written = spark.createDataFrame([("c", "FOUNDED", 1, 2), ("c", "ACQUIRED", 1, 2), ("c", "BORN_IN", 3, 4)], "chunk_id string, type string, src int, tgt int")
    s = [("FOUNDED", 1, 2, 1.0), ("FOUNDED", 2, 1, 3.0), ("ACQUIRED", 1, 2, -1.0), ("EMPLOYED_BY", 3, 2, 2.0), ("EMPLOYED_BY", 3, 1, 0.4), ("BORN_IN", 3, 2, 5.0)]
    kinds = {1: "Org", 2: "Org", 3: "Person", 4: "Place"}
    scores = spark.createDataFrame([("c", t, a, b, m, kinds[a], kinds[b], k) for k, (t, a, b, m) in enumerate(s)], "chunk_id string, type string, src int, tgt int, margin double, src_type string, tgt_type string, ord int")
    got = {(r.type, r.src, r.tgt, r.origin) for r in union.union(written, scores, BUSINESS.dim_legal(spark), ["chunk_id"]).collect()}
    assert got == {("FOUNDED", 1, 2, "generator"), ("EMPLOYED_BY", 3, 2, "head")}  # unscored and low ones go; the reverse pair is known
    capped = union.union(written, scores, BUSINESS.dim_legal(spark), ["chunk_id"], cap=1)
    assert capped.count() == 1
    new, kept = union.alternative_types([(1, "Place"), (2, "Person")], [], [("EMPLOYED_BY", 2, 1, 2.0), ("BORN_IN", 2, 1, -1.0)], BUSINESS)
    assert new == {1: "Org"} and kept == [("EMPLOYED_BY", 2, 1)]


def chunk_graph(spark):
    e = [("d", 0, 0, "e1", "Person", "Anna Holm"), ("d", 0, 1, "e2", "Org", "Kessler AB"), ("d", 1, 0, "e1", "Person", "Holm"), ("d", 1, 1, "e2", "Org", "the company"), ("d", 1, 2, "e3", "Person", "She")]
    entities = spark.createDataFrame([(*x, {"k": str(x[1])}) for x in e], "doc_id string, chunk int, ord int, ent_id string, type string, name string, attributes map<string,string>")
    m = [("d", 0, "e1", 0, "Anna Holm", 0), ("d", 0, "e2", 0, "Kessler AB", 16), ("d", 0, "e2", 1, "the company", None), ("d", 1, "e1", 0, "Holm", 40), ("d", 1, "e2", 0, "the company", None), ("d", 1, "e3", 0, "She", None)]
    mentions = spark.createDataFrame(m, "doc_id string, chunk int, ent_id string, ord int, mention string, at int")
    r = [("d", 0, 0, "EXECUTIVE_OF", "e1", "e2", 0.5, "head"), ("d", 1, 0, "EXECUTIVE_OF", "e1", "e2", 0.9, "generator"), ("d", 1, 1, "MET_WITH", "e1", "e3", None, "generator")]
    relations = spark.createDataFrame([(*x[:6], "asserted", *x[6:]) for x in r], "doc_id string, chunk int, ord int, type string, source string, target string, modality string, score double, origin string")
    return entities, mentions, relations


def test_resolution_and_graphs(spark):
    entities, mentions, relations = chunk_graph(spark)
    groups = resolution.entity_groups(entities, mentions).cache()
    got = {(r.chunk, r.ent_id): r.merged_id for r in groups.collect()}
    assert got[0, "e1"] == got[1, "e1"] == "e1" and got[0, "e2"] == got[1, "e2"] == "e2" and got[1, "e3"] == "e3"
    assert {(r.rule) for r in resolution.union_log(entities, mentions).collect()} == {"b", "c"}
    rel = resolution.rewritten(relations, groups, BUSINESS.symmetric())
    only = rel.collect()
    assert [(r.type, r.source, r.target, r.score, r.origin, r.chunks) for r in only] == [("EXECUTIVE_OF", "e1", "e2", 0.9, "generator", [0, 1])]
    assert resolution.rewritten(relations, groups, BUSINESS.symmetric(), drop_unnamed=False).count() == 2
    docs = spark.createDataFrame([("d", "Anna Holm leads Kessler AB." + " " * 13 + "Holm spoke.")], "doc_id string, text string")
    found = resolution.occurrences(mentions, groups, docs)
    assert {(r.merged_id, r.mention, r.start, r.end) for r in found.collect()} == {("e1", "Anna Holm", 0, 9), ("e2", "Kessler AB", 16, 26), ("e1", "Holm", 40, 44)}
    ents = resolution.document_entities(entities, mentions, groups, found)
    one = {r.ent_id: r for r in ents.collect()}
    assert one["e2"].aliases == ["the company"] and one["e1"].name == "Anna Holm" and one["e1"].attributes == {"k": "0"} and one["e3"].unnamed
    nodes, edges = graph.nodes_and_edges(ents, rel, found, BUSINESS.symmetric())
    lines = graph.json_graphs(nodes, edges).cache()
    g = json.loads(lines.first().value)["graph"]
    assert set(g["nodes"]) == {"e1", "e2", "e3", "document"} and [e["id"] for e in g["edges"]] == ["m0", "m1", "m2", "r0"]
    assert graph.graph_errors(lines).first().errors == []
    bad = lines.withColumn("value", F.regexp_replace("value", '"relation":"EXECUTIVE_OF"', '"extra":1'))
    assert graph.graph_errors(bad).first().errors == ["edge r0.extra"]
    back_nodes, back_edges = graph.read_json_graphs(lines)
    assert {r.label for r in back_nodes.collect()} == {"Anna Holm", "Kessler AB", "She"} and [r.relation for r in back_edges.collect()] == ["EXECUTIVE_OF"]
    tree = ET.fromstring(graph.graphml(nodes, edges).first().value.split("?>", 1)[1])
    assert len([x for x in tree.iter() if x.tag.endswith("}node")]) == 4 and len([x for x in tree.iter() if x.tag.endswith("}edge")]) == 4


def test_evaluation(spark):
    span = "chunk_id string, ent string, ord int, type string, start int, end int"
    gold = spark.createDataFrame([("c", "g1", 0, "Person", 0, 10), ("c", "g1", 0, "Person", 20, 23), ("c", "g2", 1, "Org", 30, 40)], span)
    pred = spark.createDataFrame([("c", "p1", 0, "Person", 0, 10), ("c", "p2", 1, "Person", 20, 23), ("c", "p3", 2, "Org", 50, 60)], span)
    row = evaluation.entity_strict(gold, pred).first()
    assert (row.tp, row.fp, row.fn, row.precision) == (2, 1, 1, 0.6667)
    assert tuple(evaluation.coreference(gold, pred).first())[:3] == (0, 0, 1)
    al = evaluation.aligned(pred, gold).cache()
    assert {r.pred_ent: r.gold_ent for r in al.collect()} == {"p1": "g1", "p2": "g1", "p3": None}
    rel = "chunk_id string, type string, src string, tgt string"
    g = spark.createDataFrame([("c", "FOUNDED", "g1", "g2"), ("c", "MET_WITH", "g2", "g1")], rel)
    p = spark.createDataFrame([("c", "FOUNDED", "p1", "p3"), ("c", "FOUNDED", "p2", "p3"), ("c", "MET_WITH", "p1", "p2")], rel)
    row = evaluation.relation_strict(g, p, al, {"MET_WITH"}).first()
    assert (row.tp, row.fp, row.fn) == (0, 2, 2)  # two triples without a gold end read alike
    both = evaluation.relation_pairs(g, p, al).first()
    assert (both.tp, both.fn) == (0, 1)
    nothing = evaluation.counted(evaluation.compared(g.limit(0), p.limit(0), ["chunk_id", "type"]))
    assert nothing.first().f1 == 0.0


def test_judging(spark):
    claims = spark.createDataFrame([("d", "s1", "A", "OWNS", "B"), ("d", "s2", "A", "OWNS", "B"), ("d", "s1", "A Corp", "OWNS", "B"), ("d", "s2", "C", "MET", "D")], "doc_id string, source string, src string, type string, tgt string")
    pool = judging.pooled(claims).cache()
    assert {(r.src, tuple(r.sources)) for r in pool.collect()} == {("A", ("s1", "s2")), ("A Corp", ("s1",)), ("C", ("s2",))}
    docs = spark.createDataFrame([("d", "A  owns B.")], "doc_id string, text string")
    v = pool.select("doc_id", "n").crossJoin(spark.createDataFrame([("j1", "A owns B"), ("j2", "A owns\nB.")], "judge string, quote string")).withColumn("verdict", F.lit(True))
    v = v.withColumn("quote", F.when(F.col("n") == pool.where("src = 'C'").first().n, "").otherwise(F.col("quote")))
    ok = judging.checked_verdicts(v, docs)
    true = judging.judged_true(pool, ok).cache()
    assert {r.src: r.is_true for r in true.collect()} == {"A": True, "A Corp": True, "C": False}
    assert judging.disagreement(ok).first().differ == 0
    alias = judging.alias_groups(spark.createDataFrame([("d", "A", "A Corp")], "doc_id string, a string, b string"), written)
    facts = judging.facts(true, alias).cache()
    assert facts.count() == 2
    score = {r.source: r for r in judging.scored(judging.per_document(facts, ["s1", "s2"]), ["source"]).collect()}
    assert (score["s1"].precision, score["s1"].recall, score["s2"].precision) == (1.0, 1.0, 0.5)
    more = judging.with_source(pool, spark.createDataFrame([("d", "A", "OWNS", "B"), ("d", "X", "OWNS", "Y")], "doc_id string, src string, type string, tgt string"), "s3")
    got = {r.src: (r.n, r.sources) for r in more.collect()}
    assert got["X"] == (4, ["s3"]) and got["A"][1] == ["s1", "s2", "s3"]
    low = judging.interval(judging.replicates(judging.per_document(facts, ["s1", "s2"]), 40), ["source"], "f1", 40)
    assert {r.source for r in low.collect()} == {"s1", "s2"}
    names = spark.createDataFrame([("d", "x", 0, "Acme AB", "Org", ["Acme", "the firm"]), ("d", "y", 0, "acme", "Org", []), ("d", "y", 1, "the firm", "Org", [])], "doc_id string, source string, ord int, name string, type string, mentions array<string>")
    canon = {r.key: r.canonical for r in judging.canonical_names(names, written).collect()}
    assert canon["acme"] == "Acme AB" and canon["the firm"] == "Acme AB"
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51)], "a long, b long")
    assert {r.least for r in judging.components(chain, lambda d: d.cache()).collect()} == {0, 50}


def test_calibration_and_density(spark):
    data = [("T", k / 20, k >= 12) for k in range(20)] + [("rare", 0.9, True)]
    got = {r.type: r.threshold for r in union.calibrated(spark.createDataFrame(data, "type string, p double, gold boolean")).collect()}
    assert got["T"] == 0.55 and got["rare"] == got["*"]
    few = spark.createDataFrame([("c", "T", 1, 2, 0.7)], "chunk_id string, type string, src int, tgt int, p double")
    many = few.unionByName(spark.createDataFrame([("c", "T", 1, k, 0.1) for k in range(3, 60)], few.schema))
    t = spark.createDataFrame([("*", 0.6)], "type string, threshold double")
    assert union.zero_shot(few, t, ["chunk_id"]).count() == 1 and union.zero_shot(many, t, ["chunk_id"]).count() == 0


def test_labels(spark):
    docs = spark.createDataFrame([(f"g{k % 7}-{k}", f"Text number {k}. It ends.") for k in range(40)], "doc_id string, text string")
    own = labels.group_split(docs, r"^(g\d+)-").withColumn("g", F.substring("doc_id", 1, 2))
    assert own.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert own.where("split = 'test'").select("g").distinct().count() == 1 and own.count() == 40
    assert labels.ingested(docs).where("split = 'test'").count() == 4
    lines = spark.createDataFrame([("f", 0, "## c#1"), ("f", 1, "drop E1"), ("f", 2, ""), ("f", 3, "## c#2"), ("f", 4, "flip R1")], "file string, k int, line string")
    assert rows(labels.answer_sections(lines)) == [("c#1", 1, "drop E1"), ("c#2", 4, "flip R1")]
    assert {r.batch for r in labels.draft_batches(docs.withColumnRenamed("doc_id", "chunk_id"), 30, 25).collect()} == {0, 1}


def test_carried_entities_in_batch_and_stream(spark, tmp_path):
    data = [("d", 0, 1, "Person", ["Anna"]), ("d", 1, 1, "Org", ["She", "Anna H"]), ("d", 1, 2, "Org", ["Acme"]), ("e", 0, 1, "Place", ["Oslo"])]
    schema = "doc_id string, chunk int, number int, type string, surfaces array<string>"
    answers_ = spark.createDataFrame(data, schema)
    batch = rows(carry.known(answers_))
    assert batch == [("d", 1, "Person", ["Anna", "She", "Anna H"], 1), ("d", 2, "Org", ["Acme"], 1), ("e", 1, "Place", ["Oslo"], 0)]
    assert carry.listed(carry.known(answers_), 1).where("doc_id = 'd'").first().number == 1
    for k, v in carry.STATE_STORE.items():
        spark.conf.set(k, v)
    path, at = str(tmp_path / "in"), str(tmp_path / "state")

    def run(more):
        """A query that starts anew on the same checkpoint, takes what has come and ends."""
        spark.createDataFrame(more, schema).write.mode("append").json(path)
        told = []
        q = carry.known_stream(spark.readStream.schema(schema).json(path)).writeStream.outputMode("update").foreachBatch(lambda df, _: told.extend(rows(df))).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return told

    assert run(data[:1]) == [("d", 1, "Person", ["Anna"], 0)]
    assert sorted(run(data[1:])) == batch
    assert rows(carry.known_state(spark, at)) == batch
    assert run([("d", 2, 2, "Org", ["Acme", "it"])]) == [("d", 2, "Org", ["Acme", "it"], 2)]  # other entries aren't written again


def test_files_and_proposers(spark, tmp_path):
    (tmp_path / "a doc.txt").write_text("Hello\nthere")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.md").write_text("no")
    assert {(r.doc_id, r.text) for r in files.text_files(spark, str(tmp_path)).collect()} >= {("a doc", "Hello\nthere")}
    (tmp_path / "scores.json").write_text(json.dumps({"c1": {"OWNS 1 2": 0.5, "OWNS 2 1": -1.0}}))
    s = files.pair_scores(spark, str(tmp_path / "scores.json"))
    assert rows(s) == [("c1", "OWNS", 1, 2, 0.5), ("c1", "OWNS", 2, 1, -1.0)]
    assert json.loads(files.scores_json(s).first().value) == {"c1": {"OWNS 1 2": 0.5, "OWNS 2 1": -1.0}}

    def ask(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    got = {r.chunk_id: (r.raw, r.error) for r in http.asked(spark.createDataFrame([("1", "a"), ("2", "bad")], "chunk_id string, prompt string"), ask).collect()}
    assert got == {"1": ("A", None), "2": (None, "ValueError: no")}


def test_ontology_tables(spark):
    legal = BUSINESS.dim_legal(spark)
    assert legal.count() == sum(len(r.ends) for r in BUSINESS.relations)
    rel = spark.createDataFrame([(0, "a", "b", "FOUNDED", "Org", "Org"), (1, "b", "a", "MET_WITH", "Person", "Person"), (2, "a", "b", "ASSOCIATE_OF", "Person", "Person"), (3, "a", "x", "HELD_AT", "Event", "Place")], "ord int, source string, target string, type string, src_type string, tgt_type string")
    got = {(r.type, r.fine_type) for r in ontology.coarsen(rel, []).collect()}
    assert got == {("OWNS", "FOUNDED"), ("ASSOCIATED_WITH", "MET_WITH")}
    assert rows(ontology.map_types(rel.select("type"), {"FOUNDED": "SET_UP"})) == [("SET_UP",)]
