import json
import os

import pytest

from loomspan.operators import exports
from loomspan.sources import formats, graph


def told(df):
    return sorted((*r[:8], tuple(sorted((r[8] or {}).items()))) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    formats.register(spark)
    made = []
    for d in range(40):
        made += [(f"d{d}", "node", f"n{k}", f"Näme\n{k}", None, None, None, None, {"kind": "entity", "type": "Org"}) for k in range(d % 4 + 1)]
        made += [(f"d{d}", "edge", f"r{k}", "OWNS", "n0", f"n{k}", "OWNS", k % 2 == 0, {"kind": "relation"}) for k in range(d % 4)]
    return spark.createDataFrame(made, formats.GRAPH_ROWS).repartition(3, "doc_id").sortWithinPartitions("doc_id", "kind")


def plain(df):
    return sorted(map(str, told(df)))


def test_graphs_come_back(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "graphs")
    rows.write.format("jgf").mode("append").save(path)
    assert plain(spark.read.format("jgf").load(path)) == plain(rows)
    assert len(os.listdir(path)) == 3 and not any(n.startswith("_") for n in os.listdir(path))
    lines = spark.read.text(path).withColumnRenamed("value", "value").selectExpr("get_json_object(value, '$.graph.id') AS doc_id", "value")
    assert graph.graph_errors(lines).where("size(errors) > 0").count() == 0
    rows.write.format("jgf").mode("overwrite").save(f"file://{path}")
    assert plain(spark.read.format("jgf").load(f"file:{path}")) == plain(rows)


@pytest.mark.parametrize("step", [1, 7, 100, 257])
def test_ranges_hold_each_line_once(rows, tmp_path, monkeypatch, step):
    monkeypatch.setattr(formats, "RANGE", step)
    values = [json.dumps({"graph": {"id": f"é{k}", "nodes": {"a": {"label": "x" * k}}, "edges": []}}) for k in range(30)]
    (tmp_path / "a.jsonl").write_text("\n".join(values) + "\n\n")
    (tmp_path / "b.jsonl").write_text(values[0])
    (tmp_path / "_c.jsonl").write_text("hidden")
    reader = formats.GraphReader(str(tmp_path), False)
    got = [r[0] for p in reader.partitions() for r in reader.read(p)]
    assert sorted(got) == sorted([f"é{k}" for k in range(30)] + ["é0"])


def test_a_file_a_graph(spark, rows, tmp_path):
    path = str(tmp_path / "each")
    rows.write.format("jgf").option("per_document", "true").mode("append").save(path)
    assert sorted(os.listdir(path)) == sorted(f"d{d}.jgf.json" for d in range(40))
    assert plain(spark.read.format("jgf").option("multiline", "true").load(path)) == plain(rows)


def test_a_failed_job_leaves_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "failed")
    mixed = rows.unionByName(rows).coalesce(1)  # a graph's rows are in two places
    with pytest.raises(Exception, match="don't follow each other"):
        mixed.write.format("jgf").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="same name"):
        spark.createDataFrame([("a.json", "1"), ("a.json", "2")], "file_name string, value string").repartition(2).write.format("named_files").mode("append").save(path)
    with pytest.raises(Exception, match="no name of a file"):
        spark.createDataFrame([("../a", "1")], "file_name string, value string").write.format("named_files").mode("append").save(path)
    assert os.listdir(path) == []


def test_prompts_are_files_of_their_names(spark, tmp_path):
    formats.register(spark)
    chunks = spark.createDataFrame([(f"a#{k}", "Text.") for k in range(20)], "chunk_id string, text string").repartition(4)
    exports.write_prompts(chunks, str(tmp_path / "prompts"))
    assert sorted(os.listdir(tmp_path / "prompts")) == sorted(f"a_{k}.json" for k in range(20))
    back = {r.file_name: json.loads(r.value) for r in spark.read.format("named_files").load(str(tmp_path / "prompts")).collect()}
    assert back["a_3.json"]["chunk_id"] == "a#3"
    with pytest.raises(FileExistsError):
        exports.write_prompts(chunks, str(tmp_path / "prompts"))
