"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL.

Of most operators SQL can express a part of the result: those parts are queries of their own, checked on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, decontaminate, infilling, language, mixing, neardup, pii, quality, resampling, secrets, sharding, suffixes, tokens
from .common import table


def op1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_mixing aims at: sizes, and the targets of sources."""
    return mixing.op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def op2_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op2_pii's base patterns."""
    return pii.op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def op3_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op3_secrets' base patterns."""
    return secrets.op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op4_quality."""
    return quality.op4_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact copies among op5_neardup's groups: a document's first copy is in its group."""
    return neardup.op5_neardup(spark, sf_dir).select("doc_id", "copy_of", (F.col("group_id") <= F.col("copy_of")).alias("grouped"))


def op6_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that op6_tokens gives; a token has a byte at least."""
    return tokens.op6_tokens(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("bounded"))


def op8_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and law of op8_sharding."""
    return sharding.op8_sharding(spark, sf_dir).select("doc_id", "size", "law")


def op9_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what op9_decontaminate finds, the items that stand in a document word for word."""
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = decontaminate.op9_decontaminate(spark, sf_dir).select("doc_id", F.explode("items").alias("item_id"))
    both = hits.join(docs.select("doc_id", "text"), "doc_id").join(benchmark.select("item_id", F.col("text").alias("item")), "item_id")
    return both.where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id").distinct()


QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_pii": pii.op2_pii,
    "op3_secrets": secrets.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_neardup": neardup.op5_neardup,
    "op6_tokens": tokens.op6_tokens,
    "op7_language": language.op7_language,
    "op8_sharding": sharding.op8_sharding,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_repeats": suffixes.op10_repeats,
    "op11_resampling": resampling.op11_resampling,
    "op12_warc": archives.op12_warc,
    "op13_infilling": infilling.op13_infilling,
    "op1_targets": op1_targets,
    "op2_base": op2_base,
    "op3_base": op3_base,
    "op4_counts": op4_counts,
    "op5_copies": op5_copies,
    "op6_bytes": op6_bytes,
    "op8_sizes": op8_sizes,
    "op9_verbatim": op9_verbatim,
}

#: Words as SQL cuts them, and the letters of a word in either case.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASSIGNED = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" * (c == "_") for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(len({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE 2 END * substr({DIGITS}, len({DIGITS}) - i, 1)::INT - CASE WHEN i % 2 = 1 AND substr({DIGITS}, len({DIGITS}) - i, 1)::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0"
#: Words in lower case of A to Z, and all runs of one to three of them.
PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ALL_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
#: A checksum bit by bit: each byte comes in before eight shifts.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(h) // 2), lambda i: [('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, y: xor(xor(x, y) >> 1, (xor(x, y) & 1) * 3988292384)))"""
DRAW = "('0x' || substr(s, {}, 8))::BIGINT"
FOUND = r"list_filter(regexp_extract_all(coalesce(text, ''), '{}'), lambda x: {})"

ORACLE_SQL: dict[str, str] = {
    "op1_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s), w AS (SELECT *, rk % 3 + 1.0::DOUBLE AS weight, 3.0::DOUBLE * source_size AS ceiling FROM r),
    l AS (SELECT *, ceiling / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ceiling / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    t AS (SELECT source, source_size, least(ceiling, weight * (SELECT arg_min(level, (ratio, rk)) FROM l WHERE level <= ratio)) AS target FROM l)
    SELECT d.doc_id, d.size, t.source_size, round(t.target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "op2_base": rf"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
    CAST(len({FOUND.format(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0")}) AS BIGINT) AS n_ip,
    CAST(len({FOUND.format(r"[0-9]([\x20-]?[0-9])+", f"len({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}")}) AS BIGINT) AS n_card,
    CAST(len({FOUND.format(r"\+[0-9][\x20().0-9-]+[0-9]", f"len({DIGITS}) BETWEEN 10 AND 15")}) AS BIGINT) AS n_phone FROM documents""",
    "op3_base": rf"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({ASSIGNED})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
    CAST(len({FOUND.format("AKIA[A-Z0-9]+", "length(x) >= 18")}) AS BIGINT) AS n_access, CAST(len({FOUND.format("[0-9a-f]+", "length(x) >= 16")}) AS BIGINT) AS n_hex FROM documents""",
    "op4_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents), w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
    t AS (SELECT doc_id, i, word || chr(1) || lead(word) OVER o || chr(1) || lead(word, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    p AS (SELECT doc_id, i FROM t WHERE three IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1), c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM p, range(3) g(j) GROUP BY doc_id),
    x AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d)
    SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed FROM x LEFT JOIN c USING (doc_id)""",
    "op5_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy_of, true AS grouped FROM documents WHERE doc_id IS NOT NULL",
    "op6_bytes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, true AS bounded FROM documents",
    "op8_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "op9_verbatim": "SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "op10_repeats": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS i FROM d),
    s AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS g FROM p), f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
    m AS (SELECT s.doc_id, s.i FROM s JOIN f USING (g) WHERE s.doc_id > f.first), n AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM m),
    k AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n), r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY ALL),
    q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
    t AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans, max(b) AS upto, string_agg(substr(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(upto, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op11_resampling": f"""WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents), q AS (SELECT {PLAIN} AS w FROM benchmark),
    f AS (SELECT doc_id, unnest({ALL_RUNS}) AS f FROM d), g AS (SELECT unnest({ALL_RUNS}) AS f FROM q),
    c AS (SELECT f, count(*) AS n FROM f GROUP BY f), e AS (SELECT f, count(*) AS n FROM g GROUP BY f),
    h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM c UNION SELECT f FROM e)),
    b AS (SELECT f, {CRC32} % 10000 AS bucket FROM h),
    s AS (SELECT bucket, sum(n) AS n FROM c JOIN b USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM e JOIN b USING (f) GROUP BY bucket),
    gain AS (SELECT r AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM range(10000) x(r) LEFT JOIN s ON s.bucket = r LEFT JOIN t ON t.bucket = r),
    x AS (SELECT doc_id, sum(gain) AS weight FROM f JOIN b USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
    y AS (SELECT d.doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)),
    z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20 QUALIFY rank <= 5 * count(*) OVER () // 100)
    SELECT doc_id, n_features, weight, score, rank FROM y LEFT JOIN z USING (doc_id)""",
    "op12_warc": """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS leader FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM leader THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM leader THEN leader END AS refers_to FROM q""",
    "op13_infilling": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS s FROM documents),
    h AS (SELECT doc_id, text, u, len(u) AS n, {DRAW.format(1)} AS h1, {DRAW.format(9)} AS h2, {DRAW.format(17)} AS h3, {DRAW.format(25)} AS h4 FROM d),
    c AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(list_slice(u, 1, least(h1 % (n + 1), h2 % (n + 1))), '') AS p, array_to_string(list_slice(u, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))), '') AS m,
      array_to_string(list_slice(u, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n), '') AS s FROM h)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c""",
}
