"""Labels files, pools, prompts and drafts: tables in the shape that other programs read, and back."""

from __future__ import annotations

import hashlib
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..sources import formats
from . import evaluation, labels
from .ontology import registered
from .rows import flat_map
from . import schemas as _bundled  # noqa: F401  registers the bundled schemas

NAMED = "array<struct<name: string, type: string, mentions: array<string>>>"
CLAIMS = "array<struct<source: string, type: string, target: string>>"
POOL = {
    "items": "id string, text string, claims array<struct<n: int, source: string, type: string, target: string>>",
    "key": "id string, n int, sources array<string>, kind string",
    "verdicts": "judge string, id string, n int, verdict string, quote string",
    "aliases": "id string, name string, canonical string",
}


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def labels_of(results: DataFrame, texts: DataFrame | None = None, asserted_only: bool = True) -> DataFrame:
    """id, entities (name, type, mentions), relations by name, and the text where texts (chunk_id, text) are given.

    results: chunk_id, entities, relations. Relations between entities that are listed count, asserted ones alone unless all
    modalities are wanted; one without a modality is asserted. Chunks without entities are records too.
    """
    spoken = F.when(F.size(F.coalesce("mentions", _empty("array<string>"))) > 0, F.col("mentions")).otherwise(F.array("name"))
    e = results.select("chunk_id", F.posexplode("entities").alias("ord", "e")).select("chunk_id", "ord", F.col("e.id").alias("ent"), "e.name", "e.type", "e.mentions")
    listed = e.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("name", "type", spoken.alias("mentions")).alias("e")))), lambda x: x["e"]).alias("entities"))
    r = results.select("chunk_id", F.posexplode("relations").alias("ord", "r"))
    if asserted_only:
        r = r.where(F.coalesce(F.col("r.modality"), F.lit("asserted")) == "asserted")
    name = e.groupBy("chunk_id", "ent").agg(F.min_by("name", "ord").alias("name"))
    end = lambda k: name.select("chunk_id", F.col("ent").alias(f"_{k}"), F.col("name").alias(k))
    r = r.select("chunk_id", "ord", F.col("r.type").alias("type"), F.col("r.source").alias("_source"), F.col("r.target").alias("_target"))
    r = r.join(end("source"), ["chunk_id", "_source"]).join(end("target"), ["chunk_id", "_target"])
    claims = r.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("source", "type", "target").alias("r")))), lambda x: x["r"]).alias("relations"))
    out = results.select("chunk_id").distinct().join(listed, "chunk_id", "left").join(claims, "chunk_id", "left")
    out = out.select(F.col("chunk_id").alias("id"), F.coalesce("entities", _empty(NAMED)).alias("entities"), F.coalesce("relations", _empty(CLAIMS)).alias("relations"))
    return out if texts is None else out.join(texts.select(F.col("chunk_id").alias("id"), "text"), "id", "left")


def labels_of_gold(labelled: DataFrame) -> DataFrame:
    """Labelled chunks (chunk_id, text, gold) as labels, with all modalities; chunks without gold are left out."""
    gold = labelled.where("gold is not null").select("chunk_id", "text", "gold.entities", "gold.relations")
    return labels_of(gold, gold, asserted_only=False)


def labels_of_graphs(entities: DataFrame, relations: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Document graphs as labels: a record for each document, mentions by place after the name, each once, and asserted relations.

    entities: doc_id, ent_id, type, name, aliases; relations: doc_id, type, source, target, modality, ord; found: doc_id,
    merged_id, mention, start.
    """
    said = found.groupBy("doc_id", F.col("merged_id").alias("ent_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "mention"))), lambda x: x["mention"]).alias("_said"))
    mentions = F.array_distinct(F.concat(F.array("name"), F.coalesce("_said", _empty("array<string>")), F.coalesce("aliases", _empty("array<string>"))))
    number = F.regexp_extract("ent_id", r"(\d+)$", 1).cast("int")
    e = entities.join(said, ["doc_id", "ent_id"], "left").select("doc_id", number.alias("_n"), "ent_id", "name", F.struct("name", "type", mentions.alias("mentions")).alias("e"))
    listed = e.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "ent_id", "e"))), lambda x: x["e"]).alias("entities"))
    end = lambda k: e.select("doc_id", F.col("ent_id").alias(k), F.col("name").alias(f"_{k}"))
    r = relations.where("modality = 'asserted'").join(end("source"), ["doc_id", "source"]).join(end("target"), ["doc_id", "target"])
    claims = r.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type", F.struct(F.col("_source").alias("source"), "type", F.col("_target").alias("target")).alias("r")))), lambda x: x["r"]).alias("relations"))
    out = docs.select("doc_id", "text").join(listed, "doc_id", "left").join(claims, "doc_id", "left")
    return out.select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("entities", _empty(NAMED)).alias("entities"), F.coalesce("relations", _empty(CLAIMS)).alias("relations"))


def write_labels(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


# --- pools ---


def write_pool(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of a pool (items, key, verdicts, aliases) as JSON Lines, each in a folder of its name; verdicts and aliases may come later."""
    if unknown := sorted(set(tables) - set(POOL)):
        raise ValueError(f"no tables of a pool: {unknown}")
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def read_pool(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(POOL[name]).option("mode", "FAILFAST").json(f"{path}/{name}") for name in names or POOL}


# --- prompts and drafts ---


def prompt_files(chunks: DataFrame, schema: str = "business") -> DataFrame:
    """Chunks (chunk_id, text) -> file_name and value, a JSON object with the chunk's id and messages."""
    own = registered(schema)
    make = lambda i, t: [(prompts.file_name(str(i)), prompts.prompt_file(str(i), t or "", own))]
    return flat_map(chunks, ["chunk_id"], ["chunk_id", "text"], make, "file_name string, value string").select("file_name", "value")


def write_prompts(chunks: DataFrame, path: str, schema: str = "business") -> None:
    """A file for each chunk, named by it, in one folder, which must be empty; a job that fails leaves none."""
    formats.register(chunks.sparkSession)
    system, place = formats.filesystem(path)
    if system.get_file_info(place).is_file or system.get_file_info(place).type.name == "Directory" and formats.files_in(system, place):
        raise FileExistsError(path)
    prompt_files(chunks, schema).write.format("named_files").mode("append").save(path)


def chats(chunks: DataFrame, fmt: str = "sentences", schema: str = "business", style: str = "full") -> DataFrame:
    """Chunks (chunk_id, text, known) -> chunk_id, messages array<struct<role, content>>."""
    own = registered(schema)
    make = lambda t, known: [(prompts.messages(t or "", fmt, own, style, known),)]
    return flat_map(chunks, ["chunk_id"], ["text", "known"], make, "messages array<struct<role: string, content: string>>")


def training_examples(labelled: DataFrame, fmt: str = "sentences", style: str = "compact", held_out: dict | None = None, variants: bool = False, seed: int = 0) -> DataFrame:
    """Labelled chunks (chunk_id, text, gold, schema, known, task) -> chunk_id, schema, messages with the answer.

    Each chunk is shown under its own schema, without held-out types, and with variants under one drawn by its id; chunks of
    held-out schemas are left out, and so are those without gold. A known list's numbers are kept.
    """
    from .ontology import all_registered

    schemas, held = all_registered(), held_out or {}

    def make(chunk_id, text, gold, name, known, task):
        name = name or "business"
        if gold is None or name in held.get("schemas", ()):
            return
        schema = schemas[name]
        entities = [e | {"attributes": dict(e["attributes"] or {})} for e in gold["entities"] or []]
        relations = [r | {"attributes": dict(r["attributes"] or {})} for r in gold["relations"] or []]
        views = [schema.without(held.get("relations", ()), held.get("entities", ()))] if held.get("relations") or held.get("entities") else []
        if variants:
            draw = int(hashlib.md5(f"{seed}|{chunk_id}".encode()).hexdigest()[:8], 16)
            views.append((views[-1][0] if views else schema).variant(draw))
        for schema, named in views:
            types = {e.name for e in schema.entities}
            entities = [e for e in entities if e["type"] in types]
            of = {e["id"]: e["type"] for e in entities}
            renamed = (r | {"type": named[r["type"]]} for r in relations if r["type"] in named and {r["source"], r["target"]} <= of.keys())
            relations = [r for r in renamed if schema.legal(r["type"], of[r["source"]], of[r["target"]])]
        lines = "\n".join(known) if known is not None else None
        example = prompts.training_example(text or "", schema, entities, relations, fmt, style, task == "relations_only", lines)
        yield name, example["messages"]

    return flat_map(labelled, ["chunk_id"], ["chunk_id", "text", "gold", "schema", "known", "task"], make, "schema string, messages array<struct<role: string, content: string>>")


def draft_text(chunk_id: str, text: str, entities: list[dict], relations: list[dict]) -> str:
    """A draft as a corrector reads it: a header, numbered entities and relations, and the text."""
    number = {e["id"]: f"E{k}" for k, e in enumerate(entities, 1)}
    shown = [f"E{k} {e['type']}: {' | '.join(e['mentions'])}" for k, e in enumerate(entities, 1)]
    shown += [f"R{k} {r['type']} {number[r['source']]} {number[r['target']]}" for k, r in enumerate(relations, 1) if r["source"] in number and r["target"] in number]
    return "\n".join([f"## {chunk_id}", *shown, "", text, ""])


def draft_batches(drafts: DataFrame, n: int, size: int = 25) -> DataFrame:
    """batch, value: the n drafts (chunk_id, text, entities, relations) that come first by hash, as texts, `size` a batch; a batch's drafts are one row."""
    first = labels.draft_batches(drafts, n, size)
    texts = flat_map(first, ["batch", "chunk_id"], ["chunk_id", "text", "entities", "relations"], lambda i, t, e, r: [(draft_text(i, t or "", e or [], r or []),)], "draft string")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", "draft")))
    return texts.groupBy("batch").agg(F.array_join(F.transform(ordered, lambda x: x["draft"]), "\n").alias("value"))


INSTRUCTIONS = """Each section begins with `## <chunk id>`, then lists a draft's entities (E1, E2, ...) and relations (R1, R2, ...), then the text.
Answer with the same headers, and below each the changes, one a line: drop R1 R2, retype R2 <TYPE>, flip R2,
entity E9 <Type>: <surface> | <surface>, mention E1: <surface>, add <TYPE> E1 E2; new entities are numbered after the draft's last. A section without changes is right as it is."""


def correction_instructions(schema: str = "business") -> str:
    return "\n\n".join([INSTRUCTIONS, registered(schema).rendered(), prompts.CONVENTIONS])


def write_drafts(drafts: DataFrame, path: str, n: int, size: int = 25, schema: str = "business") -> None:
    """drafts (JSON Lines), batches (a text file in a folder batch=<k> each) and instructions, under a path."""
    spark = drafts.sparkSession
    drafts.write.mode("errorifexists").json(f"{path}/drafts")
    draft_batches(drafts, n, size).write.mode("errorifexists").partitionBy("batch").text(f"{path}/batches")
    spark.createDataFrame([(correction_instructions(schema),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/instructions")


def answer_files(spark: SparkSession, path: str) -> DataFrame:
    """file, k, line of answers_*.txt, in order within each file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="answers_*.txt").select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
    return files


def corrected_labels(drafts: DataFrame, lines: DataFrame, schema: str = "business") -> tuple[DataFrame, DataFrame]:
    """Labelled chunks of the drafts that have an answer (chunk_id, doc_id, text, entities, relations, split, schema), and a row of counts:
    drafts, answered, change lines, skipped changes, and answers that are left out for too many entities."""
    sections = labels.answer_sections(lines)
    answered = lines.where(F.col("line").startswith("## ")).select(F.trim(F.expr("substring(line, 4)")).alias("chunk_id")).where("chunk_id != ''").distinct()
    applied = labels.apply_corrections(drafts.join(answered, "chunk_id", "left_semi"), sections, schema)
    kept = applied.where("error is null").join(drafts.select("chunk_id", "doc_id", "text"), "chunk_id")
    rows = kept.select("chunk_id", "doc_id", "text", "entities", "relations", F.lit("train").alias("split"), F.lit(schema).alias("schema"))
    counts = applied.agg(F.count("*").alias("answered"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("left_out"))
    counts = counts.crossJoin(F.broadcast(drafts.agg(F.count("*").alias("drafts")))).crossJoin(F.broadcast(sections.agg(F.count("*").alias("changes"))))  # one row each
    return rows, counts


def agreement(gold: DataFrame, drafts: DataFrame, corrected: DataFrame, symmetric: set[str]) -> DataFrame:
    """source (draft, corrected) and the strict relation figures against gold, over the chunks that were corrected. All have chunk_id, entities, relations, spans."""
    own = gold.join(corrected.select("chunk_id"), "chunk_id", "left_semi")
    each = [evaluation.summarized(own, rows, symmetric).where("metric = 'rel_strict'").select(F.lit(name).alias("source"), "*") for name, rows in (("draft", drafts), ("corrected", corrected))]
    return each[0].unionByName(each[1])

