"""Spans by DataFrame functions against the functions that cut one text."""

import random

import pytest

from loomspan.functions import segment
from loomspan.operators import islands

WORDS = ["Ann", "said", "it.", "No.", "Dr.", "A.", "really?", "yes!", "U.S.", '"So', "(we", "1999", "é", "“Oh", "went", "x:", "St.", "...", "naïve", "𝒳"]
BITS = [" ", "  ", "\n", "\n\n", "\n \n", "\t", " \n", "\r\n", "\x0b", " ", "\n\n\n"]
LAID = ["| a | b |", "|---|---|", "| Group |", "|  | x.|", "- item one", "* point", "2) second", "Name: Ann Lee", "**Key:** v", "# Heading one", "## Part", "The board consists of:", "  | c | d |  ", "| a | b | c |", "|x|", "||"]


def text_of(rng):
    out = []
    for _ in range(rng.choice([0, 1, 5, 20, 60])):
        kind = rng.random()
        if kind < 0.5:
            out.append("".join(rng.choice(WORDS) + rng.choice([" "] * 8 + BITS) for _ in range(rng.randint(1, 40))))
        elif kind < 0.8:
            out.append("\n".join(rng.choice(LAID) for _ in range(rng.randint(1, 9))) + rng.choice(["\n", "\n\n", ""]))
        else:
            out.append(rng.choice(BITS) + rng.choice(LAID) + rng.choice(BITS))
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    fixed = [None, "", " ", "\n", "one", "one " * 700, "word. " * 500, "A b. C d.\n| x |\nMr. X. went. Y", "| a |\n| b |", "\n\na\n\n", "a\n \n", ". A. B", "| k | v |\n| a | b. |\n|---|---|\n| k | v |\nend"]
    return dict(enumerate(fixed + [text_of(rng) for _ in range(250)]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(
    ("relational", "plain"),
    [(islands.sentences, segment.sentences), (islands.paragraphs, segment.paragraphs), (lambda d: islands.numbered_sentences(d, "doc_id"), segment.numbered_sentences), (islands.headings, segment.heading_spans)],
    ids=["sentences", "paragraphs", "numbered", "headings"],
)
def test_spans_equal_the_function(docs, texts, relational, plain):
    df = relational(docs)
    assert "Python" not in (plan := df._jdf.queryExecution().toString()) and "InArrow" not in plan
    got = {}
    for r in df.orderBy("doc_id", "k").collect():
        got.setdefault(r.doc_id, []).append((r.k, r.start, r.end, r.text))
    for k, text in texts.items():
        want = [(i, a, b, text[a:b]) for i, (a, b) in enumerate(plain(text or ""))]
        assert got.get(k, []) == want, repr(text)


def test_tables_equal_the_function(docs, texts):
    got = {r.doc_id: r.text for r in islands.verbalized(docs).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        assert got[k] == (None if text is None else segment.verbalize(text)), repr(text)


@pytest.mark.parametrize(("max_words", "dense_words"), [(200, 80), (20, 10), (7, 3), (30, None), (5, 40)])
def test_chunks_equal_the_function(docs, texts, max_words, dense_words):
    df = islands.chunks(docs, max_words, dense_words)
    assert "Python" not in (plan := df._jdf.queryExecution().toString()) and "InArrow" not in plan
    got = {}
    for r in df.orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.start, r.end, r.text, r.context, r.dense, r.model_text))
    for k, text in texts.items():
        want = [(c.index, c.start, c.end, c.text, c.context, c.dense, c.model_text) for c in segment.chunk(text or "", max_words, dense_words)]
        assert got.get(k, []) == want, repr(text)
