from loomspan.functions import names, segment
from loomspan.operators import sql_functions

TEXT = "Ann met Bob. Bob owns “Acme”!\n\n" + "word " * 450 + "\n| a | b |\n|---|---|\n| c | d |\n\nE1 is no line"


def test_table_functions_beside_a_table(spark):
    assert "chunk" in sql_functions.register(spark)
    spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string").createOrReplaceTempView("some_documents")
    rows = spark.sql("SELECT d.doc_id, c.* FROM some_documents d, LATERAL chunk(d.text, 100, 80) c ORDER BY doc_id, chunk").collect()
    assert [tuple(r) for r in rows] == [(1, c.index, c.start, c.end, c.text, c.context, c.dense, c.model_text) for c in segment.chunk(TEXT, 100, 80)]
    assert spark.sql("SELECT count(*) FROM some_documents d, LATERAL chunk(d.text)").first()[0] == len(segment.chunk(TEXT))
    for name, cut in (("paragraphs", segment.paragraphs), ("document_sentences", segment.sentences), ("numbered_sentences", segment.numbered_sentences), ("headings", segment.heading_spans)):
        got = spark.sql(f"SELECT k, start, end, s.text FROM some_documents d, LATERAL {name}(d.text) s ORDER BY k").collect()
        assert [tuple(r) for r in got] == [(k, a, b, TEXT[a:b]) for k, (a, b) in enumerate(cut(TEXT))]
    got = spark.sql("SELECT start, end FROM some_documents d, LATERAL sentence_windows(d.text, 100, 1) ORDER BY k").collect()
    assert [tuple(r) for r in got] == segment.sentence_windows(TEXT, 100, 1)
    got = spark.sql("SELECT * FROM answer_entities('E1 Person: Ann | Bob\nS1\nE2 Org: Acme')").collect()
    assert [tuple(r) for r in got] == [(1, "Person", "Ann"), (1, "Person", "Bob"), (2, "Org", "Acme")]


def test_functions_of_columns_are_part_of_the_plan(spark):
    sql_functions.register(spark)
    said = ["Ann’s  Co., (UK) ", "", "O'Neil & Sons-x", "É!"]
    df = spark.createDataFrame([(s,) for s in said], "s string").selectExpr("s", "words_in(s) AS n", "claim_key(s) AS k", "span_f1(1, 2, 2) AS f")
    assert "Python" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        assert (r.n, r.k, r.f) == (len(r.s.split()), names.claim_key(r.s), 0.5)
