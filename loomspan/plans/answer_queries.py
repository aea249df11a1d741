"""Queries over answers in lines: decoded, stopped at repeats, checked against a schema.

Answers are made of the documents' capitalised words, one line a word, by md5: headers, entities, relations and noise, with numbers, types
and modalities that don't fit, so that every rule is broken somewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checking, decoding, judging, segmentation
from ..operators.islands import let
from ..operators.rows import written
from ..operators.schemas import BUSINESS
from .catalog import LEGAL_SQL, MENTION, NUMBERED_SQL, H, query, table

KINDS = ("Person", "Org", "Place", "Event", "Object", "Thing")
EDGES = ("EMPLOYED_BY", "LOCATED_IN", "FAMILY_OF", "HELD_AT", "FOUNDED", "LIKES", "OWNS_OBJECT", "BORN_IN")
MODES = ("asserted", "hedged", "reported", "perhaps")


def answers_of(docs: DataFrame) -> DataFrame:
    """doc_id and raw, an answer with a line for each capitalised word; a null text has a null answer."""

    def line(word, k):
        return let(judging.hashed(F.lit("a"), F.col("doc_id"), k), lambda h: said(word, k, h))

    def said(word, k, h):
        number = lambda by, of: F.pmod(F.floor(h / by), F.lit(of)).cast("string")
        pick = lambda by, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.floor(h / by), F.lit(len(of))) + 1).cast("int"))
        entity = F.concat(F.lit("E"), number(7, 12), F.lit(" "), pick(84, KINDS), F.lit(": "), word, F.lit(" | the "), F.lower(word), F.lit(" |"), word)
        relation = F.concat(F.lit("R "), pick(7, EDGES), F.lit(" E"), number(56, 12), F.lit(" E"), number(672, 12), F.lit(" "), pick(8064, MODES), F.lit(" date="), word, F.lit("; role = "), k.cast("string"))
        m = F.pmod(h, F.lit(7))
        return F.when(m == 0, F.concat(F.lit("S"), number(7, 9))).when(m <= 2, entity).when(m <= 5, relation).otherwise(F.concat(F.lit("- "), word))

    words = F.regexp_extract_all("text", F.lit(MENTION), F.lit(0))
    return docs.select("doc_id", F.array_join(F.transform(words, line), "\n").alias("raw"))


def _list(of) -> str:
    return "[" + ", ".join(f"'{x}'" for x in of) + "]"


HASH = H.format("'a|' || doc_id || '|' || (i - 1)")
RAW_SQL = f"""raw AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Z][a-z]+'), lambda t, i: CASE WHEN {HASH} % 7 = 0 THEN 'S' || ({HASH} // 7 % 9)
      WHEN {HASH} % 7 <= 2 THEN 'E' || ({HASH} // 7 % 12) || ' ' || ({_list(KINDS)})[{HASH} // 84 % 6 + 1] || ': ' || t || ' | the ' || lower(t) || ' |' || t
      WHEN {HASH} % 7 <= 5 THEN 'R ' || ({_list(EDGES)})[{HASH} // 7 % 8 + 1] || ' E' || ({HASH} // 56 % 12) || ' E' || ({HASH} // 672 % 12) || ' ' || ({_list(MODES)})[{HASH} // 8064 % 4 + 1] || ' date=' || t || '; role = ' || (i - 1)
      ELSE '- ' || t END), chr(10)) AS raw FROM documents)"""
#: The lines of answers; entities and relations that they say, before the schema is asked.
LINES_SQL = rf"""{RAW_SQL}, lines AS (SELECT doc_id, unnest(string_split(raw, chr(10))) AS line, unnest(range(len(string_split(raw, chr(10))))) AS ord FROM raw),
    marked AS (SELECT *, line[1] AS kind, last_value(CASE WHEN line[1] = 'S' THEN substr(line, 2)::INT END IGNORE NULLS) OVER w AS sentence, sum((line[1] = 'E')::INT) OVER w AS nth_e, sum((line[1] = 'R')::INT) OVER w AS nth_r FROM lines
      WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    ent AS (SELECT doc_id, ord, 'e' || regexp_extract(line, '^E(\d+)', 1) AS ent_id, regexp_extract(line, '^E\d+ (\w+):', 1) AS type, list_transform(string_split(substr(line, instr(line, ': ') + 2), '|'), lambda x: trim(x)) AS names FROM marked WHERE kind = 'E' AND nth_e <= 40
      QUALIFY row_number() OVER (PARTITION BY doc_id, ent_id ORDER BY ord) = 1),
    rel AS (SELECT doc_id, ord, regexp_extract(line, '^R (\w+)', 1) AS type, 'e' || regexp_extract(line, ' E(\d+) E', 1) AS source, 'e' || regexp_extract(line, ' E\d+ E(\d+) ', 1) AS target, regexp_extract(line, ' E\d+ E\d+ (\w+)', 1) AS modality,
      regexp_extract(line, 'date=(\w+)', 1) AS date, regexp_extract(line, 'role = (\d+)', 1) AS role, sentence FROM marked WHERE kind = 'R' AND nth_r <= 40)"""


def _decoded(spark, sf_dir) -> decoding.Decoded:
    docs = table(spark, sf_dir, "documents")
    return decoding.decoded(answers_of(docs), segmentation.numbered_sentences(docs, "doc_id"), "sentences", "doc_id")


@query(
    "decoded_entities",
    f"""WITH {LINES_SQL} SELECT doc_id, CAST(ord AS INTEGER) AS ord, ent_id, type, names[1] AS name, array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), '|') AS mentions FROM ent""",
)
def decoded_entities(spark, sf_dir):
    """The first entity line of each number."""
    return _decoded(spark, sf_dir).entities.withColumn("mentions", F.array_join("mentions", "|"))


@query(
    "decoded_relations",
    f"""WITH {LINES_SQL}, s AS ({NUMBERED_SQL}), t AS (SELECT doc_id, s.k, substr(text, CAST(s."start" + 1 AS BIGINT), CAST(s."end" - s."start" AS BIGINT)) AS evidence FROM s JOIN documents USING (doc_id))
    SELECT rel.doc_id, CAST(ord AS INTEGER) AS ord, type, source, target, modality, md5(coalesce(evidence, chr(0) || 'missing sentence' || chr(0))) AS evidence, date, role FROM rel LEFT JOIN t ON t.doc_id = rel.doc_id AND t.k + 1 = sentence""",
)
def decoded_relations(spark, sf_dir):
    """Relations under the header that was last before them, with the sentence of that number as their evidence."""
    r = _decoded(spark, sf_dir).relations
    return r.select("doc_id", "ord", "type", "source", "target", "modality", F.md5("evidence").alias("evidence"), F.col("attributes")["date"].alias("date"), F.col("attributes")["role"].alias("role"))


@query(
    "answer_outcomes",
    f"""WITH {LINES_SQL}, c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'E') AS e, count(*) FILTER (WHERE kind = 'R') AS r, count(*) FILTER (WHERE kind = '-') AS bad FROM marked GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM ent GROUP BY doc_id)
    SELECT raw.doc_id, coalesce(n, 0) AS n_entities, least(coalesce(r, 0), 40) AS n_relations, coalesce(bad, 0) AS malformed, CASE WHEN raw IS NULL THEN 'no answer' WHEN e + r = 0 AND bad > 0 THEN 'sentences: no parseable line (' || bad || ' malformed)' END AS error
    FROM raw LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def answer_outcomes(spark, sf_dir):
    return _decoded(spark, sf_dir).outcomes


@query(
    "answers_without_repeats",
    rf"""WITH RECURSIVE {RAW_SQL}, lines AS MATERIALIZED (SELECT doc_id, unnest(string_split(raw, chr(10))) AS line, unnest(range(len(string_split(raw, chr(10))))) AS ord FROM raw),
    step AS (SELECT doc_id, -1::BIGINT AS ord, []::VARCHAR[] AS seen, false AS skips, []::VARCHAR[] AS kept FROM raw WHERE raw IS NOT NULL
      UNION ALL SELECT doc_id, l.ord, CASE WHEN l.line[1] = 'R' AND NOT skips THEN list_append(seen, regexp_extract(l.line, '^R (\S+ \S+ \S+)', 1)) ELSE seen END,
        CASE WHEN l.line[1] = 'S' THEN false WHEN l.line[1] = 'R' AND NOT skips THEN list_contains(seen, regexp_extract(l.line, '^R (\S+ \S+ \S+)', 1)) ELSE skips END,
        CASE WHEN l.line[1] = 'S' OR NOT skips THEN list_append(kept, l.line) ELSE kept END FROM step s JOIN lines l USING (doc_id) WHERE l.ord = s.ord + 1)
    SELECT doc_id, len(arg_max(kept, ord)) AS lines, md5(array_to_string(arg_max(kept, ord), chr(10))) AS kept FROM step GROUP BY doc_id""",
)
def answers_without_repeats(spark, sf_dir):
    """Answers that stop at repeats, as how many lines stay and their hash."""
    kept = answers_of(table(spark, sf_dir, "documents")).where("raw is not null").withColumn("raw", decoding.without_repeats(F.col("raw")))
    return kept.select("doc_id", F.size(F.split("raw", "\n")).cast("long").alias("lines"), F.md5("raw").alias("kept"))


TYPES_SQL = "types(type) AS (VALUES " + ", ".join(f"('{e.name}')" for e in BUSINESS.entities) + ")"
KNOWN_SQL = "known(type, keys) AS (VALUES " + ", ".join(f"('{r.name}', {list(r.attributes) or '[]::VARCHAR[]'})" for r in BUSINESS.relations) + ")"


def _graph(spark, sf_dir):
    """Entities and relations, written down: rules read them several times, and answers are decoded once for each."""
    got = _decoded(spark, sf_dir)
    entities, relations = written(got.entities.select("doc_id", "ord", "ent_id", "type")), written(got.relations.drop("evidence"))
    schema_of = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.lit("business").alias("schema"))
    return entities, relations, schema_of, checking.Rules.of(spark, [BUSINESS])


@query(
    "schema_violations",
    f"""WITH {LINES_SQL}, {TYPES_SQL}, {KNOWN_SQL}, {LEGAL_SQL}, j AS (SELECT rel.*, a.type AS a, b.type AS b FROM rel LEFT JOIN ent a ON a.doc_id = rel.doc_id AND a.ent_id = source LEFT JOIN ent b ON b.doc_id = rel.doc_id AND b.ent_id = target),
    v AS (SELECT doc_id, 'unknown_type' AS rule, type AS what FROM ent WHERE type NOT IN (SELECT type FROM types)
      UNION ALL SELECT doc_id, 'missing_end', type FROM j WHERE a IS NULL OR b IS NULL
      UNION ALL SELECT doc_id, 'unknown_relation', type FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND type NOT IN (SELECT type FROM known)
      UNION ALL SELECT doc_id, 'illegal_ends', type || ' ' || a || ' ' || b FROM j WHERE type IN (SELECT type FROM known) AND NOT EXISTS (SELECT 1 FROM legal WHERE rel_type = j.type AND src_type = a AND tgt_type = b) AND a IS NOT NULL AND b IS NOT NULL)
    SELECT doc_id, rule, what, count(*) AS n FROM v GROUP BY ALL""",
)
def schema_violations(spark, sf_dir):
    """How often each document's answer breaks each rule of its schema; what is missing an end is known by its type alone."""
    entities, relations, schema_of, rules = _graph(spark, sf_dir)
    found = checking.violations(entities, relations, schema_of, rules, "doc_id")
    return found


RETYPED_SQL = f"""{LINES_SQL}, {TYPES_SQL}, {KNOWN_SQL}, {LEGAL_SQL}, kept AS (SELECT * FROM ent WHERE type IN (SELECT type FROM types)),
    j AS (SELECT rel.*, a.type AS a, b.type AS b FROM rel JOIN kept a ON a.doc_id = rel.doc_id AND a.ent_id = source JOIN kept b ON b.doc_id = rel.doc_id AND b.ent_id = target WHERE source <> target AND rel.type IN (SELECT type FROM known)),
    alt(kind, o) AS (VALUES ('Person', 1), ('Org', 2), ('Place', 3)),
    mine AS (SELECT doc_id, ord, source AS ent_id, a AS now, type, b AS other, true AS first FROM j UNION ALL SELECT doc_id, ord, target, b, type, a, false FROM j),
    t AS (SELECT m.*, kind, o, EXISTS (SELECT 1 FROM legal WHERE rel_type = m.type AND src_type = CASE WHEN first THEN kind ELSE other END AND tgt_type = CASE WHEN first THEN other ELSE kind END) AS fits,
      EXISTS (SELECT 1 FROM legal WHERE rel_type = m.type AND src_type = CASE WHEN first THEN now ELSE other END AND tgt_type = CASE WHEN first THEN other ELSE now END) AS fit FROM mine m, alt WHERE now IN ('Person', 'Org', 'Place') AND kind <> now),
    swaps AS (SELECT doc_id, ent_id, kind, o FROM t GROUP BY ALL HAVING sum(fits::INT) > sum(fit::INT) AND bool_and(fits OR NOT fit)),
    new AS (SELECT doc_id, ent_id, arg_min(kind, o) AS new_type FROM swaps GROUP BY ALL)"""


@query("retyped_entities", f"WITH {RETYPED_SQL} SELECT doc_id, ent_id, new_type FROM new")
def retyped_entities(spark, sf_dir):
    """People, organisations and places that their relations show to be of another of these types."""
    entities, relations, schema_of, rules = _graph(spark, sf_dir)
    known = entities.where(F.col("type").isin(*(e.name for e in BUSINESS.entities)))
    return checking.retypings(known, relations, schema_of, rules, "doc_id")


LENIENT_SQL = f"""{RETYPED_SQL}, fresh AS (SELECT kept.doc_id, kept.ent_id, coalesce(new_type, type) AS type FROM kept LEFT JOIN new USING (doc_id, ent_id)),
    k AS (SELECT rel.*, a.type AS a, b.type AS b FROM rel LEFT JOIN fresh a ON a.doc_id = rel.doc_id AND a.ent_id = source LEFT JOIN fresh b ON b.doc_id = rel.doc_id AND b.ent_id = target),
    sole AS (SELECT src_type, tgt_type, min(rel_type) AS edge FROM legal GROUP BY ALL HAVING count(*) = 1),
    f AS (SELECT k.*, edge, CASE WHEN modality NOT IN ('asserted', 'negated', 'hedged', 'reported') OR a IS NULL OR b IS NULL OR type NOT IN (SELECT type FROM known) THEN 'dropped'
      WHEN EXISTS (SELECT 1 FROM legal WHERE rel_type = k.type AND src_type = a AND tgt_type = b) THEN 'kept' WHEN edge IS NOT NULL THEN 'repaired' ELSE 'illegal' END AS fate FROM k LEFT JOIN sole ON src_type = a AND tgt_type = b)"""


@query(
    "lenient_relations",
    f"""WITH {LENIENT_SQL} SELECT doc_id, CAST(ord AS INTEGER) AS ord, CASE fate WHEN 'repaired' THEN edge ELSE f.type END AS type, source, target, CASE WHEN fate = 'kept' OR list_contains(keys, 'date') THEN date END AS date, CASE WHEN fate = 'kept' OR list_contains(keys, 'role') THEN role END AS role
    FROM f JOIN known ON known.type = CASE fate WHEN 'repaired' THEN edge ELSE f.type END WHERE fate IN ('kept', 'repaired')""",
)
def lenient_relations(spark, sf_dir):
    """Relations that stay, under the type and with the attributes that are legal."""
    r = checking.lenient(*_graph(spark, sf_dir), key="doc_id").relations
    return r.select("doc_id", "ord", "type", "source", "target", F.col("attributes")["date"].alias("date"), F.col("attributes")["role"].alias("role"))


@query(
    "lenient_counts",
    f"""WITH {LENIENT_SQL}, r AS (SELECT doc_id, count(*) FILTER (WHERE fate IN ('dropped', 'illegal')) AS dropped, count(*) FILTER (WHERE fate = 'illegal') AS illegal, count(*) FILTER (WHERE fate = 'repaired') AS repaired FROM f GROUP BY doc_id),
    e AS (SELECT doc_id, count(*) FILTER (WHERE type NOT IN (SELECT type FROM types)) AS unknown_types FROM ent GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS retyped FROM new GROUP BY doc_id)
    SELECT doc_id, coalesce(unknown_types, 0) AS unknown_types, coalesce(retyped, 0) AS retyped, coalesce(dropped, 0) AS dropped, coalesce(illegal, 0) AS illegal, coalesce(repaired, 0) AS repaired
    FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN e USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)""",
)
def lenient_counts(spark, sf_dir):
    return checking.lenient(*_graph(spark, sf_dir), key="doc_id").counts.drop("over_cap", "error")
