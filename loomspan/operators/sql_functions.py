"""The engine in SQL: functions and table functions of a session, so that texts are cut and answers read in a query.

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk(d.text, 200, 80) c

Table functions get one text a call and yield its rows; the functions of columns are SQL themselves and fold into the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import answers, segment
from .islands import S

SPAN = "k int, start int, end int, text string"


def _spans(cut: Callable[..., list]) -> type:
    class Spans:
        def eval(self, text: str, *options) -> Iterator[tuple]:
            for k, (a, b) in enumerate(cut(text or "", *options)):
                yield k, a, b, text[a:b]

    return Spans


class Chunk:
    """chunk(text[, max_words[, dense_words]]); a null dense_words takes dense blocks as prose."""

    def eval(self, text: str, max_words: int = 200, dense_words: int = 80) -> Iterator[tuple]:
        for c in segment.chunk(text or "", max_words, dense_words):
            yield c.index, c.start, c.end, c.text, c.context, c.dense, c.model_text


class AnswerLines:
    """answer_lines(raw): number, type and one name of each entity line, in order."""

    def eval(self, raw: str) -> Iterator[tuple]:
        for number, kind, surfaces in answers.entity_lines(raw or ""):
            for name in surfaces:
                yield number, kind, name


TABLE_FUNCTIONS = {
    "chunk": (Chunk, "chunk int, start int, end int, text string, context string, dense boolean, model_text string"),
    "paragraphs": (_spans(segment.paragraphs), SPAN),
    "document_sentences": (_spans(segment.sentences), SPAN),
    "numbered_sentences": (_spans(segment.numbered_sentences), SPAN),
    "sentence_windows": (_spans(segment.sentence_windows), SPAN),
    "line_windows": (_spans(segment.line_windows), SPAN),
    "headings": (_spans(segment.heading_spans), SPAN),
    "answer_entities": (AnswerLines, "number int, type string, name string"),
}
#: Functions of columns, as SQL that Spark takes into the plan.
FUNCTIONS = {
    "words_in": ("text STRING", "INT", f"""size(filter(split(text, r"{S}+"), w -> w != ''))"""),
    "claim_key": ("name STRING", "STRING", r"""trim(regexp_replace(regexp_replace(lower(name), r"(?U)[^\w\s]", ''), r"(?U)\s+", ' '))"""),
    "span_f1": ("found BIGINT, given BIGINT, gold BIGINT", "DOUBLE", "CASE WHEN given + gold = 0 THEN 0.0D ELSE round(2.0D * found / (given + gold), 4) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds all to a session, for its life, and returns their names."""
    for name, (made, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(made, returnType=schema))
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return [*TABLE_FUNCTIONS, *FUNCTIONS]
