"""Answers in lines as relations: lines exploded, headers carried by a window, first wins by min_by. No Python runs on a row.

The answers are dealt out by their key once; all windows, groups and joins of a key find its rows together after that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import MAX_ENTITIES, MAX_MENTIONS, MAX_RELATIONS, NO_SENTENCE
from ..functions.names import DESCRIPTIVE
from .islands import let

#: Where lines end, and what is white space around one, as Java patterns.
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085\u2028\u2029]"
BLANKS = r"[\s\x1C-\x1F\u0085\p{Z}]+"
#: A list of names that has one.
NAMED = r"[^\s\x1C-\x1F\u0085\p{Z}|]"
# The lines of an answer.
ENTITY = r"(?U)^E(\d+) (\w+): (.+)$"
HEADER = r"(?U)^S(\d+)$"
RELATION = r"(?U)^R (\w+) E(\d+) E(\d+) (\w+) S(\d+)(?: (.*))?$"
UNDER_HEADER = r"(?U)^R (\w+) E(\d+) E(\d+) (\w+)(?: (.*))?$"


@dataclass
class Decoded:
    """entities: key, ord, ent_id, type, name, mentions. relations: key, ord, type, source, target, modality, evidence, attributes. outcomes: key, n_entities, n_relations, malformed, error."""

    entities: DataFrame
    relations: DataFrame
    outcomes: DataFrame


def stripped(text: Column) -> Column:
    """Without the white space around it; the pattern runs only over texts whose ends are blank."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(BLANKS), F.regexp_replace(text, rf"^{BLANKS}|{BLANKS}\z", "")).otherwise(text)


def surfaces_of(listed: Column) -> Column:
    """The distinct names of a list with | between them, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(listed, r"\|"), stripped), lambda s: s != ""))


def shown_name(surfaces: Column) -> Column:
    """The longest surface that has a capital and no determiner before it; else the longest. The first of equals."""
    described = lambda s: F.lower(s).rlike("^(" + "|".join(DESCRIPTIVE) + ")")
    named = F.filter(surfaces, lambda s: ~described(s) & s.rlike(r"[\p{Lu}\p{Lt}]"))
    longest = lambda of: F.array_max(F.transform(of, lambda s, k: F.struct(F.char_length(s).alias("n"), (-k).alias("k"), s.alias("s"))))["s"]
    best = let(named, lambda of: F.when(F.size(of) > 0, longest(of)).otherwise(F.coalesce(longest(surfaces), F.lit(""))))
    return F.when(F.size(surfaces) == 1, F.coalesce(F.get(surfaces, F.lit(0)), F.lit(""))).otherwise(best)


def attributes_of(listed: Column) -> Column:
    """key=value pairs with ; between them as a map; the last of a key counts."""
    pairs = F.filter(F.split(F.coalesce(listed, F.lit("")), ";"), lambda p: p.contains("="))
    cut = F.transform(pairs, lambda p: F.struct(stripped(F.substring_index(p, "=", 1)).alias("k"), stripped(p.substr(F.instr(p, "=") + 1, F.char_length(p))).alias("v")))
    later = lambda whole, i: F.transform(F.slice(whole, i + 2, F.size(whole)), lambda q: q["k"])
    last = lambda whole: F.filter(whole, lambda p, i: ~F.array_contains(later(whole, i), p["k"]))
    return F.map_from_entries(let(F.filter(cut, lambda p: (p["k"] != "") & (p["v"] != "")), last))


def answer_lines(answers: DataFrame, key: str, fmt: str) -> DataFrame:
    """key, ord, line, kind (e, h, r, x; null for an answer without lines), and what the line's pattern holds, for answers (key, raw)."""
    line = answers.select(key, (F.col("raw").isNull()).alias("absent"), F.posexplode_outer(F.split(stripped(F.col("raw")), LINE_ENDS)).alias("ord", "line"))
    line = line.withColumn("line", stripped(F.col("line"))).withColumn("line", F.when(F.col("line") != "", F.col("line")))
    is_one = lambda letter, pattern: F.col("line").startswith(letter) & F.col("line").rlike(pattern)  # noqa: E731  a pattern tries each place of a line that it doesn't fit
    header = F.lit(False) if fmt == "lines" else is_one("S", HEADER)
    kind = F.when(is_one("E", ENTITY), "e").when(header, "h").when(is_one("R ", RELATION if fmt == "lines" else UNDER_HEADER), "r").when(F.col("line").isNotNull(), "x")
    return line.withColumn("kind", kind)


def decoded(answers: DataFrame, sentences: DataFrame, fmt: str = "sentences", key: str = "chunk_id") -> Decoded:
    """What answers (key, raw) in lines say of texts whose numbered sentences are given (key, k from 0, text).

    fmt: sentences (relations stand under headers) or lines (they name their sentence). Entity lines without a name count as malformed;
    of lines with the same number the first counts; the first MAX_ENTITIES entity lines and MAX_RELATIONS relations count, and
    MAX_MENTIONS names of an entity. A relation whose sentence isn't there has evidence that no text contains. An answer none of whose
    lines can be read, and a null one, is an error; an empty one says nothing. Keys must be unique among the answers; sentences
    without an answer are ignored.
    """
    own = answer_lines(answers.select(key, "raw").repartition(F.col(key)), key, fmt)
    relation, attrs_at = (RELATION, 6) if fmt == "lines" else (UNDER_HEADER, 5)
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    own = own.withColumn("kind", F.when((F.col("kind") == "e") & ~part(ENTITY, 3).rlike(NAMED), "x").otherwise(F.col("kind")))
    w = W.partitionBy(key).orderBy("ord")
    number = lambda text: text.try_cast("int")
    carried = F.last(F.when(F.col("kind") == "h", F.struct(number(part(HEADER, 1)).alias("n"))), ignorenulls=True).over(w)["n"]
    own = own.withColumn("sentence", number(part(RELATION, 5)) if fmt == "lines" else carried)
    nth = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).over(w)
    own = own.withColumn("nth", F.when(F.col("kind") == "e", nth("e")).when(F.col("kind") == "r", nth("r")))
    entity = own.where((F.col("kind") == "e") & (F.col("nth") <= MAX_ENTITIES)).withColumn("ent_id", F.concat(F.lit("e"), part(ENTITY, 1)))
    first = entity.groupBy(key, "ent_id").agg(F.min_by(F.struct("ord", "line"), "ord").alias("e")).select(key, "ent_id", "e.*").withColumn("surfaces", surfaces_of(part(ENTITY, 3)))
    entities = first.select(key, "ord", "ent_id", part(ENTITY, 2).alias("type"), shown_name(F.col("surfaces")).alias("name"), F.slice("surfaces", 1, MAX_MENTIONS).alias("mentions"))
    texts = sentences.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("texts"))
    there = own.where((F.col("kind") == "r") & (F.col("nth") <= MAX_RELATIONS)).join(texts, key, "left")
    within = (F.col("sentence") >= 1) & (F.col("sentence") <= F.size("texts"))
    evidence = F.when(within, F.try_element_at("texts", F.when(within, F.col("sentence")))["text"]).otherwise(NO_SENTENCE)
    end = lambda k: F.concat(F.lit("e"), part(relation, k))
    relations = there.select(key, "ord", part(relation, 1).alias("type"), end(2).alias("source"), end(3).alias("target"), part(relation, 4).alias("modality"), evidence.alias("evidence"), attributes_of(part(relation, attrs_at)).alias("attributes"))
    count = lambda k: F.count_if(F.col("kind") == k)
    sums = own.groupBy(key).agg(count("e").alias("e"), count("r").alias("r"), count("x").alias("malformed"), F.bool_or("absent").alias("absent"), F.count_distinct(F.when((F.col("kind") == "e") & (F.col("nth") <= MAX_ENTITIES), part(ENTITY, 1))).alias("n_entities"))
    wrong = (F.col("e") + F.col("r") == 0) & (F.col("malformed") > 0)
    error = F.when(F.col("absent"), "no answer").when(wrong, F.concat(F.lit(f"{fmt}: no parseable line ("), F.col("malformed").cast("string"), F.lit(" malformed)")))
    outcomes = sums.select(key, "n_entities", F.least("r", F.lit(MAX_RELATIONS)).cast("long").alias("n_relations"), "malformed", error.alias("error"))
    return Decoded(entities, relations, outcomes)


def decoded_json(answers: DataFrame, key: str = "chunk_id") -> Decoded:
    """What answers (key, raw) in JSON say: an object with entities and relations, perhaps within a code fence or other text.

    The object is read as a VARIANT and looked at in its row, without a shuffle. An entity without an id, type, name or mentions, too many
    entities and too many mentions are errors of the whole answer, and so is text that is no JSON or says a key twice. A relation that
    lacks a field has a null in its place; one without a modality is asserted. Values that are no text are no attributes.
    """
    bare = F.regexp_replace(stripped(F.col("raw")), rf"^```\w*{BLANKS}|^```\w*|{BLANKS}```\z|```\z", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), F.when(body != "", body), F.lit("]"))), "$", "array<variant>")  # a list, so that nothing may follow the object
    got = answers.select(key, F.col("raw").isNull().alias("absent"), body.alias("body"), F.when(F.size(one) == 1, one[0]).alias("v"))
    listed = lambda path: F.try_variant_get("v", path, "array<variant>")
    text = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    strings = lambda v: F.filter(F.transform(F.try_variant_get(v, "$.mentions", "array<variant>"), lambda m: text(m, "$")), lambda m: m.isNotNull())
    attributes = lambda v: F.coalesce(F.map_filter(F.transform_values(F.try_variant_get(v, "$.attributes", "map<string, variant>"), lambda _, x: text(x, "$")), lambda _, x: x.isNotNull()), F.create_map().cast("map<string, string>"))

    def entity(v: Column) -> Column:
        mentions = strings(v)
        whole = F.size(F.try_variant_get(v, "$.mentions", "array<variant>")) == F.size(mentions)
        return F.struct(text(v, "$.id").alias("ent_id"), text(v, "$.type").alias("type"), text(v, "$.name").alias("name"), F.when(whole & (F.size(mentions) > 0), mentions).alias("mentions"))

    relation = lambda v: F.struct(
        *(text(v, f"$.{k}").alias(k) for k in ("type", "source", "target")), F.when(F.try_variant_get(v, "$.modality", "variant").isNull(), F.lit("asserted")).otherwise(text(v, "$.modality")).alias("modality"), text(v, "$.evidence").alias("evidence"), attributes(v).alias("attributes")
    )
    got = got.withColumn("es", F.transform(listed("$.entities"), entity)).withColumn("rs", F.coalesce(F.transform(listed("$.relations"), relation), F.array().cast("array<struct<type: string, source: string, target: string, modality: string, evidence: string, attributes: map<string, string>>>")))
    there = F.try_variant_get("v", "$.entities", "variant").isNotNull()
    got = got.withColumn("es", F.when(there, F.col("es")).otherwise(F.array().cast("array<struct<ent_id: string, type: string, name: string, mentions: array<string>>>")))
    broken = F.col("es").isNull() | F.exists("es", lambda e: e["ent_id"].isNull() | e["type"].isNull() | e["name"].isNull() | e["mentions"].isNull())
    error = F.when(F.col("absent"), "no answer").when(F.col("body") == "", "no JSON object").when(F.col("v").isNull(), "json: malformed").when(broken, "schema: an entity lacks a field")
    error = error.when(F.size("es") > MAX_ENTITIES, f"schema: at most {MAX_ENTITIES} entities").when(F.exists("es", lambda e: F.size(e["mentions"]) > MAX_MENTIONS), f"schema: at most {MAX_MENTIONS} mentions")
    got = got.withColumn("error", error)
    sound = got.where("error is null")
    entities = sound.select(key, F.posexplode("es").alias("ord", "e")).select(key, "ord", "e.*")
    relations = sound.select(key, F.posexplode("rs").alias("ord", "r")).select(key, "ord", "r.*")
    n = lambda c: F.when(F.col("error").isNull(), F.size(c)).otherwise(0).cast("long")
    return Decoded(entities, relations, got.select(key, n("es").alias("n_entities"), n("rs").alias("n_relations"), F.lit(0).cast("long").alias("malformed"), "error"))


def without_repeats(raw: Column) -> Column:
    """An answer that stops at repeats: in the block of a header, what follows the first relation line that the answer has already is left out.

    Lines that are left out aren't remembered, so what is a repeat depends on all that came before: a fold over the lines.
    """
    words = lambda line: F.filter(F.split(line, BLANKS), lambda x: x != "")
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("seen"), F.lit(False).alias("skips"), none.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        heads, relates = line.startswith("S"), line.startswith("R ")
        kept = heads | ~acc["skips"]
        named = F.array_join(F.slice(words(line), 2, 3), " ")
        again = F.array_contains(acc["seen"], named)
        counts = kept & relates & ~heads
        seen = F.when(counts & ~again, F.array_append(acc["seen"], named)).otherwise(acc["seen"])
        skips = F.when(heads, False).when(counts, again).otherwise(acc["skips"])
        return F.struct(seen.alias("seen"), skips.alias("skips"), F.when(kept, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(raw, "\n"), begin, step, lambda acc: F.array_join(acc["out"], "\n"))
