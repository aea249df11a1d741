"""Label data: splits, teacher prompts and answers, windows, corrections. Draws are by hash, so every run agrees."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import segment, validate
from ..functions.answers import MAX_ENTITIES, MAX_RELATIONS
from .judging import hashed
from .ontology import registered
from .rows import flat_map, ranked
from .segmentation import chunks


def group_split(chunk_table: DataFrame, pattern: str = "", val: float = 0.1, test: float = 0.1, salt: str = "split") -> DataFrame:
    """Adds split (train, val, test) by document group: the first group of the pattern in doc_id, or the document. Groups come in the order of
    their hash; the first round(n * test) are test, at least one, the next round(n * val) val. No group is in two splits."""
    name = F.regexp_extract("doc_id", pattern, 1) if pattern else F.col("doc_id").cast("string")
    df = chunk_table.withColumn("_group", name)
    groups = ranked(df.select("_group").distinct(), hashed(F.lit(salt), F.col("_group")), "_group")
    n = groups.agg(F.count("*").alias("_n"))
    n_test, n_val = F.greatest(F.lit(1), F.round(F.col("_n") * test)), F.round(F.col("_n") * val)
    placed = groups.crossJoin(F.broadcast(n))  # one row
    split = F.when(F.col("_rank") <= n_test, "test").when(F.col("_rank") <= n_test + n_val, "val").otherwise("train")
    return df.join(placed.select("_group", split.alias("split")), "_group").drop("_group")


def ingested(docs: DataFrame, test: float = 0.1, max_words: int = 200, dense_words: int | None = 80) -> DataFrame:
    """Documents as labelled chunks without gold: chunk_id (doc#k), doc_id, text, schema, split."""
    c = chunks(docs, max_words, dense_words)
    c = c.select(F.concat_ws("#", F.col("doc_id").cast("string"), "chunk").alias("chunk_id"), "doc_id", "text")
    return group_split(c, val=0.0, test=test).withColumn("schema", F.lit("business"))


def safe_name(chunk_id):
    """A chunk's id as a file name."""
    return F.regexp_replace(chunk_id, "#", "_")


def with_answers(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with their teacher's answer (name, raw), null where there is none."""
    return prompts.withColumn("_name", safe_name(F.col("chunk_id"))).join(answers.select(F.col("name").alias("_name"), "raw"), "_name", "left").drop("_name")


def import_counts(results: DataFrame) -> DataFrame:
    """One row: how many answers are missing, failed, over a cap, and how many relations and mentions were dropped."""
    n = lambda c: F.count_if(c).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    missing, failed = F.col("error") == "no answer", F.col("error").isNotNull()
    return results.agg(F.count("*").alias("chunks"), n(missing).alias("missing"), n(failed & ~missing & ~F.col("over_cap")).alias("skipped"), n(F.col("over_cap")).alias("over_cap"), total("dropped_relations"), total("repaired_relations"), total("unresolved_mentions"), total("unresolved_evidence"))


WINDOW = "window string, start int, end int, text string, entities array<string>, relations array<struct<type: string, source: string, target: string>>"


def windows(labelled: DataFrame, max_chars: int, overlap: int = 1) -> DataFrame:
    """Labelled chunks (chunk_id, text, entities, relations) cut into sentence windows with the gold that lies in each."""

    def make(text, entities, relations):
        for k, (a, b) in enumerate(segment.sentence_windows(text or "", max_chars, overlap)):
            own, kept = validate.project(entities or [], relations or [], text[a:b])
            yield f"w{k}", a, b, text[a:b], [e["id"] for e in own], [{k: r[k] for k in ("type", "source", "target")} for r in kept]

    return flat_map(labelled, ["chunk_id"], ["text", "entities", "relations"], make, WINDOW)


def draft_batches(chunk_table: DataFrame, n: int, size: int = 25, salt: str = "draft") -> DataFrame:
    """The n chunks that come first by hash, with batch numbers; n is how many drafts are wanted."""
    first = chunk_table.orderBy(hashed(F.lit(salt), F.col("chunk_id")), "chunk_id").limit(n)
    rank = F.row_number().over(W.orderBy(hashed(F.lit(salt), F.col("chunk_id")), "chunk_id"))
    return first.withColumn("batch", F.floor((rank - 1) / size).cast("int"))


def answer_sections(files: DataFrame) -> DataFrame:
    """Lines (file, k, line) of correction answers -> chunk_id, k, line under its header `## id`; of several sections of a chunk the last one, by file and place."""
    head = F.when(F.col("line").startswith("## "), F.trim(F.expr("substring(line, 4)")))
    w = W.partitionBy("file").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    df = files.withColumn("_head", head).withColumn("chunk_id", F.last("_head", ignorenulls=True).over(w))
    df = df.withColumn("_section", F.struct("file", F.count("_head").over(w).alias("n")))
    last = df.where("_head is not null").groupBy("chunk_id").agg(F.max("_section").alias("_last"))
    kept = df.where("_head is null and chunk_id is not null and trim(line) != ''").join(last, "chunk_id").where("_section = _last")
    return kept.select("chunk_id", "k", F.trim("line").alias("line"))


class Draft:
    """A chunk's draft under correction: entities by E-number, relations by name as (type, source number, target number). A line that can't be followed raises."""

    def __init__(self, text: str, entities: list[dict], relations: list[dict], schema):
        self.text, self.schema = text, schema
        self.entities = {f"E{k}": dict(e) for k, e in enumerate(entities, 1)}
        named = {e["id"]: k for k, e in zip(self.entities, entities, strict=True)}
        self.relations = {f"R{k}": [r["type"], named.get(r["source"]), named.get(r["target"])] for k, r in enumerate(relations, 1)}
        self.types = {e.name for e in schema.entities}

    def follow(self, line: str) -> None:
        word, *rest = line.split()
        {"drop": self.drop, "retype": self.retype, "flip": self.flip, "add": self.add}.get(word, lambda *_: self.name(line))(*rest)

    def drop(self, *names: str) -> None:
        for name in names:
            self.relations.pop(name, None)

    def retype(self, name: str, kind: str, *_: str) -> None:
        self.relations[name][0] = kind

    def flip(self, name: str, *_: str) -> None:
        self.relations[name][1:] = self.relations[name][:0:-1]

    def add(self, kind: str, source: str, target: str, *_: str) -> None:
        self.relations[f"A{len(self.relations)}_{source}_{target}"] = [kind, source, target]

    def name(self, line: str) -> None:
        """An entity with a number of its own, or another name of one."""
        if m := ENTITY_LINE.match(line):
            there = [s for part in m[3].split("|") if (s := part.strip()) and s in self.text]
            if not there or m[2] not in self.types:
                raise ValueError(line)
            self.entities[m[1]] = {"id": m[1].lower(), "type": m[2], "name": there[0], "attributes": {}, "mentions": there}
        elif m := MENTION_LINE.match(line):
            known = self.entities[m[1]]
            if (surface := m[2].strip()) in self.text:
                known["mentions"] = [*known["mentions"], surface]
        else:
            raise ValueError(line)


# The lines of a correction that name something.
ENTITY_LINE = re.compile(r"entity (E\d+) (\w+): (.+)$")
MENTION_LINE = re.compile(r"mention (E\d+): (.+)$")


def corrected(text: str, entities: list[dict], relations: list[dict], lines: list[str], schema) -> tuple[list[dict], list[dict], int, str | None]:
    """(entities, relations, skipped, error) after the changes, in order: drop R1 R2, retype R1 TYPE, flip R1, entity E9 Type: a | b, mention E1: a, add TYPE E1 E2.

    Entities are renamed e1, e2, … by their numbers. Lines that can't be followed, relations that are illegal, double or without an end, and
    spare entities beyond the limit, the last first, are skipped and counted.
    """
    draft, skipped = Draft(text, entities, relations, schema), 0
    for line in lines:
        try:
            draft.follow(line.strip())
        except (KeyError, TypeError, ValueError):
            skipped += 1
    types = {k: e["type"] for k, e in draft.entities.items()}
    legal = [tuple(r) for r in draft.relations.values() if r[1] in types and r[2] in types and r[1] != r[2] and schema.legal(r[0], types[r[1]], types[r[2]])]
    kept = list(dict.fromkeys(legal))
    skipped += len(draft.relations) - len(kept)
    kept = kept[:MAX_RELATIONS]
    linked = {end for _, a, b in kept for end in (a, b)}
    spare = [k for k in draft.entities if k not in linked][::-1][: max(0, len(types) - MAX_ENTITIES)]
    skipped += len(spare)
    rest = [e | {"id": k.lower()} for k, e in draft.entities.items() if k not in set(spare)]
    if len(rest) > MAX_ENTITIES:
        return [], [], skipped, f"at most {MAX_ENTITIES} entities"
    made = [{"type": t, "source": a.lower(), "target": b.lower(), "modality": "asserted", "evidence": "", "attributes": {}} for t, a, b in kept]
    return rest, made, skipped, None


def apply_corrections(drafts: DataFrame, lines: DataFrame, schema: str = "business") -> DataFrame:
    """Drafts (chunk_id, text, entities, relations) with their correction lines applied: chunk_id, entities, relations, skipped, error."""
    from .answers import ENTITY, RELATION

    own = lines.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    own_schema = registered(schema)

    def make(text, entities, relations, changes):
        plain = lambda xs: [x | {"attributes": dict(x["attributes"] or {})} for x in xs or []]
        es, rs, bad, error = corrected(text or "", plain(entities), plain(relations), changes or [], own_schema)
        listed = lambda xs: [x | {"attributes": list(x["attributes"].items())} for x in xs]
        yield listed(es), listed(rs), bad, error

    return flat_map(drafts.join(own, "chunk_id", "left"), ["chunk_id"], ["text", "entities", "relations", "lines"], make, f"entities array<{ENTITY}>, relations array<{RELATION}>, skipped int, error string")
