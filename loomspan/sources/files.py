"""Text and JSON Lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start: int, end: int>"
ENTITY = "struct<id: string, type: string, name: string, attributes: map<string, string>, mentions: array<string>>"
RELATION = "struct<type: string, source: string, target: string, attributes: map<string, string>, modality: string, evidence: string>"
OUTPUT = f"struct<entities: array<{ENTITY}>, relations: array<{RELATION}>>"
RESULT = f"chunk_id string, format string, raw string, error string, seconds double, output {OUTPUT}, unresolved_mentions int, unresolved_evidence int, dropped_relations int, illegal_relations int, resolved_spans map<string, array<array<int>>>, schema string"
LABELLED = f"chunk_id string, doc_id string, text string, gold {OUTPUT}, schema string, split string, entity_map map<string, string>, known array<string>, task string"


def stem(path):
    """A file's name without folder and extension."""
    return F.regexp_replace(F.regexp_extract(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"([^/]+)$", 1), r"\.[^.]*$", "")


def text_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.txt") -> DataFrame:
    """One document a file: doc_id (the file's stem) and text."""
    df = spark.read.text(paths, wholetext=True, pathGlobFilter=pattern)
    return df.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Records under a fixed schema; blank lines are no records, malformed ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def labelled(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_lines(spark, paths, LABELLED)


def checked_labelled(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labelled chunks with `errors`, every rule of the record's schema that its gold breaks; a schema that isn't registered is one."""
    from ..functions.validate import strict_errors
    from ..operators.ontology import all_registered
    from ..operators.rows import flat_map

    schemas = all_registered()

    def make(gold, name):
        schema = schemas.get(name or "business")
        broken = [f"unknown schema {name}"] if schema is None else strict_errors(gold["entities"] or [], gold["relations"] or [], schema) if gold else []
        yield (broken,)

    rows = labelled(spark, paths).withColumn("_gold", F.col("gold"))
    columns = [c for c in rows.columns if c != "_gold"]
    return flat_map(rows.withColumn("_name", F.col("schema")), columns, ["_gold", "_name"], make, "errors array<string>")


def results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return json_lines(spark, paths, RESULT)


def reread(stored: DataFrame, texts: DataFrame | None = None, schema: str | None = None, per_chunk: DataFrame | None = None, repair: bool = False) -> DataFrame:
    """Stored results as results() reads them: chunk_id, entities, relations, spans, error, counts, seconds and schema.

    The schema is the argument, or per_chunk's (chunk_id, schema), or the stored one, or business; one that isn't registered fails
    the read, as a type that another schema lacks would be dropped in silence. Chunks whose text (texts: chunk_id, text) is given
    are parsed and located anew from what was answered, so that changes to these rules need no new answers.
    """
    from ..operators import answers
    from ..operators.ontology import all_registered

    df = stored if per_chunk is None else stored.join(per_chunk.select("chunk_id", F.col("schema").alias("_given")), "chunk_id", "left")
    name = F.coalesce(F.lit(schema) if schema else F.lit(None).cast("string"), F.col("_given") if per_chunk is not None else F.lit(None).cast("string"), "schema", F.lit("business"))
    wrong = F.raise_error(F.concat(F.lit("result "), "chunk_id", F.lit(" names a schema that is not registered: "), name)).cast("string")
    df = df.withColumn("schema", F.when(name.isin(*all_registered()), name).otherwise(wrong)).drop("_given")
    nothing = F.lit(0)
    if texts is None:
        again = None
        old = df
    else:
        df = df.join(texts.select("chunk_id", "text"), "chunk_id", "left")
        anew = df.where("text is not null")
        again = answers.results(anew.select("chunk_id", "text", "raw", F.col("format").alias("fmt"), "schema"), repair).join(anew.select("chunk_id", "seconds", "schema"), "chunk_id")
        old = df.where("text is null").drop("text")
    relation = answers.RELATION
    kept = old.select(
        "chunk_id", F.col("output.entities").alias("entities"), F.transform("output.relations", lambda r: F.struct(r["type"].alias("type"), r["source"].alias("source"), r["target"].alias("target"), r["modality"].alias("modality"), r["evidence"].alias("evidence"), r["attributes"].alias("attributes"))).cast(f"array<{relation}>").alias("relations"),
        F.transform_values("resolved_spans", lambda _, spans: F.transform(spans, lambda s: F.struct(s[0].alias("start"), s[1].alias("end")))).alias("spans"), "error", F.lit(False).alias("over_cap"), *(F.coalesce(F.col(c), nothing).alias(c) if c in old.columns else nothing.alias(c) for c in answers.COUNTS), "seconds", "schema",
    )
    return kept if again is None else again.unionByName(kept)


def result_records(results: DataFrame, asked: DataFrame) -> DataFrame:
    """Results (chunk_id, entities, relations, spans, error, counts) and what they were made of (chunk_id, raw, fmt, seconds, schema) as the
    records that other readers expect: format, raw, error, seconds, output (entities and relations, null after an error), counts, resolved_spans and schema."""
    r = results.join(asked.select("chunk_id", "raw", F.col("fmt").alias("format"), "seconds", "schema"), "chunk_id")
    count = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    output = F.when(F.col("error").isNull(), F.struct("entities", "relations")).alias("output")
    pairs = F.transform_values(F.coalesce("spans", F.create_map().cast("map<string, array<struct<start: int, end: int>>>")), lambda _, spans: F.transform(spans, lambda s: F.array(s["start"], s["end"]))).alias("resolved_spans")
    return r.select("chunk_id", "format", "raw", "error", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), output, *(count(c) for c in ("unresolved_mentions", "unresolved_evidence", "dropped_relations", "illegal_relations")), pairs, "schema")


def write_results(rows: DataFrame, path: str) -> None:
    """Records as JSON Lines with all their keys: null ones are written as null, but for the schema, which is left out."""
    if "schema" not in rows.columns:
        rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
        return
    keys = [c for c in rows.columns if c != "schema"]
    bare = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    more = F.concat(F.expr("substring(_bare, 1, char_length(_bare) - 1)"), F.lit(',"schema":'), F.to_json(F.array("schema")).substr(F.lit(2), F.char_length(F.to_json(F.array("schema"))) - 2), F.lit("}"))
    rows.withColumn("_bare", bare).select(F.when(F.col("schema").isNull(), F.col("_bare")).otherwise(more).alias("value")).write.mode("errorifexists").text(path)


def pair_scores(spark: SparkSession, path: str) -> DataFrame:
    """{chunk: {"TYPE i j": margin}} -> chunk_id, type, src, tgt, margin."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, double>>").alias("m"))
    pairs = raw.select(F.explode("m").alias("chunk_id", "own")).select("chunk_id", F.explode("own").alias("k", "margin")).withColumn("k", F.split("k", " "))
    return pairs.select("chunk_id", F.col("k")[0].alias("type"), F.col("k")[1].cast("int").alias("src"), F.col("k")[2].cast("int").alias("tgt"), "margin")


def scores_json(scores: DataFrame) -> DataFrame:
    """chunk_id and its margins as the JSON object that pair_scores reads, one a line."""
    key = F.concat_ws(" ", "type", F.col("src").cast("string"), F.col("tgt").cast("string"))
    per = scores.groupBy("chunk_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), "margin")))).alias("m"))
    return per.select("chunk_id", F.to_json(F.map_from_arrays(F.array("chunk_id"), F.array("m"))).alias("value"))


def metrics_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
