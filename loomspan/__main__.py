"""The command line: python -m loomspan <verb> ..., or spark-submit loomspan/__main__.py <verb> ...

Each verb reads tables or files, runs operators as Spark jobs and writes what they give; only short texts and figures are printed. Paths
may lie wherever Spark can reach them; a folder that is there already isn't written over.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import prompts
from loomspan.functions.matching import resolve_spans
from loomspan.operators import answers, evaluation, exports, judging, labels, schemas, segmentation
from loomspan.operators.answers import ENTITY, RELATION
from loomspan.operators.ontology import all_registered, registered
from loomspan.operators.rows import flat_map, written
from loomspan.sources import files, formats, graph

CHUNKS = "doc_id string, chunk_id string, split string, text string"
VERBS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def verb(name: str, *arguments: str, **options):
    """Registers a verb; arguments are positional, options have defaults."""

    def keep(f: Callable) -> Callable:
        VERBS[name] = f, [*((a, {}) for a in arguments), *((f"--{k.replace('_', '-')}", {"default": v, "action": "store_true"} if v is False else {"default": v, "type": type(v)}) for k, v in options.items())]
        return f

    return keep


def _save(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def _show(rows: DataFrame) -> None:
    """A small table of figures, a JSON object a line."""
    for row in rows.collect():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))


@verb("chunk", "texts", "out", max_words=200, dense_words=80)
def chunk(spark, texts, out, max_words, dense_words):
    """Text files -> their chunks, with offsets and context."""
    _save(segmentation.chunks(files.text_files(spark, texts), max_words, dense_words), out)


@verb("ingest", "texts", "out", test=0.1)
def ingest(spark, texts, out, test):
    """Text files -> chunks to be labelled, with a split."""
    _save(labels.ingested(files.text_files(spark, texts), test), out)


@verb("split", "chunks", "out", pattern="", val=0.1, test=0.1)
def split(spark, chunks, out, pattern, val, test):
    """A chunk table with its split drawn anew, by what the pattern finds in document ids."""
    rows = spark.read.json(chunks)
    _save(labels.group_split(rows.drop("split"), pattern, val, test), out)


@verb("prompts", "chunks", "out", schema="business")
def write_prompts(spark, chunks, out, schema):
    """A prompt file for each chunk."""
    exports.write_prompts(spark.read.json(chunks).select("chunk_id", "text"), out, schema)


@verb("import", "chunks", "raw", "out", format="json", schema="business", repair=False)
def import_answers(spark, chunks, raw, out, format, schema, repair):
    """Answer files, named by their chunks, -> results; prints how many are missing, failed or over a limit."""
    formats.register(spark)
    own = spark.read.format("named_files").load(raw).select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("name"), F.col("value").alias("raw"))
    asked = labels.with_answers(spark.read.json(chunks).select("chunk_id", "text"), own).withColumns({"fmt": F.lit(format), "schema": F.lit(schema), "seconds": F.lit(0.0)})
    results = written(answers.results(asked, repair))
    files.write_results(files.result_records(results, asked), out)
    _show(labels.import_counts(results))


def _gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled chunks as results, with the places of their entities."""
    rows = files.labelled(spark, path).where("gold is not null").select("chunk_id", F.coalesce("schema", F.lit("business")).alias("schema"), "text", F.col("gold.entities").alias("entities"), F.transform("gold.relations", lambda r: F.struct(*(r[k].alias(k) for k in ("type", "source", "target", "modality", "evidence", "attributes")))).cast(f"array<{RELATION}>").alias("relations"))
    place = lambda t, es: [([(i, [{"start": a, "end": b} for a, b in s]) for i, s in resolve_spans(t or "", {e["id"]: e["mentions"] for e in es or []})[0].items()],)]
    spans = flat_map(rows, ["chunk_id"], ["text", "entities"], place, "spans map<string, array<struct<start: int, end: int>>>")
    return rows.withColumn("entities", F.col("entities").cast(f"array<{ENTITY}>")).join(spans, "chunk_id")


@verb("eval", "gold", "results", by_type=False)
def evaluate(spark, gold, results, by_type):
    """Results against labelled chunks: seven metrics, each chunk under its own schema."""
    own = _gold(spark, gold)
    got = files.reread(files.results(spark, results), own.select("chunk_id", "text"), per_chunk=own.select("chunk_id", "schema"))
    _show(evaluation.evaluated(own, got, all_registered(), by_type=by_type).orderBy("schema", "metric", "type"))
    _show(evaluation.summary(own, got))


@verb("draft", "chunks", "results", "out", n=50, size=25, schema="business")
def draft(spark, chunks, results, out, n, size, schema):
    """Drafts to be corrected, in batches, with instructions."""
    texts = spark.read.json(chunks).select("chunk_id", "doc_id", "text")
    got = files.reread(files.results(spark, results), texts).where("error is null").join(texts, "chunk_id")
    exports.write_drafts(got.select("chunk_id", "doc_id", "text", "entities", "relations"), out, n, size, schema)


@verb("correct", "drafts", "answers", "out", schema="business")
def correct(spark, drafts, answers, out, schema):
    """Drafts with their corrections (answers_*.txt) -> labelled chunks; prints what was followed and skipped."""
    given = spark.read.schema(f"chunk_id string, doc_id string, text string, entities array<{ENTITY}>, relations array<{RELATION}>").json(f"{drafts}/drafts")
    rows, counts = exports.corrected_labels(given, exports.answer_files(spark, answers), schema)
    _save(rows, out)
    _show(counts)


@verb("aliases", "labels", "out")
def aliases(spark, labels, out):
    """Names that labellers' entities tie together; labels: JSON Lines files, a labeller each."""
    rows = spark.read.schema(f"id string, entities {exports.NAMED}").json(labels).select(F.col("id").alias("doc_id"), F.col("_metadata.file_path").alias("source"), F.posexplode("entities").alias("ord", "e"))
    _save(judging.labelled_aliases(rows.select("doc_id", "source", "ord", "e.name", "e.type", "e.mentions"), written), out)


@verb("check-graphs", "graphs")
def check_graphs(spark, graphs):
    """Graphs, one a line, that aren't what the format allows; prints each with its errors."""
    lines = spark.read.text(graphs).select(F.coalesce(F.get_json_object("value", "$.graph.id"), F.lit("?")).alias("doc_id"), "value")
    _show(graph.graph_errors(lines).where("size(errors) > 0"))


@verb("schema", "name")
def schema(spark, name):
    print(registered(name).rendered())


@verb("guide")
def guide(spark):
    print(prompts.CONVENTIONS)


@verb("brief", "name")
def brief(spark, name):
    """What judges of claims are told."""
    print(prompts.judging_brief(registered(name)))


@verb("query", "name", "tables", "out")
def run_query(spark, name, tables, out):
    """A query of the catalogue over a folder of tables, as Parquet."""
    from loomspan.plans import answer_queries, pool_queries, score_queries  # noqa: F401  these add their queries
    from loomspan.plans.catalog import QUERIES

    QUERIES[name](spark, tables).write.mode("errorifexists").parquet(out)


def main(arguments: list[str], spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomspan", description="Typed knowledge graphs from texts, as Spark jobs.")
    parsers = parser.add_subparsers(dest="verb", required=True)
    for name, (f, own) in VERBS.items():
        sub = parsers.add_parser(name, help=(f.__doc__ or "").strip() or None)
        for flag, options in own:
            sub.add_argument(flag, **options)
    given = vars(parser.parse_args(arguments))
    work = VERBS[given.pop("verb")][0]
    work(spark or SparkSession.builder.appName("loomspan").getOrCreate(), **given)


assert schemas  # the bundled schemas are registered

if __name__ == "__main__":
    main(sys.argv[1:])
