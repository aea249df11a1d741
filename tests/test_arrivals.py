from pyspark.sql import functions as F

from loomspan.operators import segmentation
from loomspan.sources import http
from loomspan.streaming import documents


def test_prompts_by_length(spark):
    prompts = spark.createDataFrame([(f"c{k}", "x" * (k * 7 % 50)) for k in range(60)], "chunk_id string, prompt string").repartition(5)
    out = http.asked(prompts, lambda p: str(len(p)), 3, 2, by_length=True)
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 60 and all(r.error is None for r in rows)
    spans = sorted((min(int(r.raw) for r in rows if r.part == p), max(int(r.raw) for r in rows if r.part == p)) for p in {r.part for r in rows})
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_documents_come_one_by_one_and_in_batches(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"One {k}. Two.") for k in range(6)], "doc_id long, text string")
    assert sum(r["doc_id"] for r in documents.one_by_one(docs.repartition(3))) == 15
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = documents.batches(stream, lambda batch: segmentation.sentences(batch), str(tmp_path / "out"), str(tmp_path / "at"))
    query.awaitTermination(60)
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 12 and got.select("batch").distinct().count() == 2
