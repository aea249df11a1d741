import random
import re

from pyspark.sql import functions as F

from loomspan.llm import infilling

from .helpers import docs, empty, odd


def test_every_form_gives_the_text_back(spark):
    rng = random.Random(5)
    bits = ["a", "é", "𝒳", "\n", "\n\n", "\r\n", "<", "<P", "S>", ">", " ", "<M", "🦊x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    made = infilling.fill_in_middle(docs(spark, texts)).withColumn("back", infilling.restored(F.col("form"), F.col("output"))).collect()
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    for r in made:
        text, units = texts[r.doc_id], re.findall(r"[^\n]*\n|[^\n]+", texts[r.doc_id])
        assert r.back == text and r.n == len(units)
        if r.form == "plain":
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None
            assert not text or any(m in text for m in infilling.MARKS)
        else:
            a, b = r.prefix_chars, r.prefix_chars + r.middle_chars
            ends = [sum(map(len, units[:k])) for k in range(len(units) + 1)]
            assert a in ends and b in ends
            pre, mid, suf = text[:a], text[a:b], text[b:]
            assert r.output == (f"<P>{pre}<S>{suf}<M>{mid}" if r.form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def test_other_units_rates_and_marks(spark):
    texts = [f"one two three {k}" for k in range(200)]
    words = infilling.fill_in_middle(docs(spark, texts), pattern=r"\S+\s*", spm=100).collect()
    assert all(r.n == 4 and r.form == "spm" for r in words)
    some = infilling.fill_in_middle(docs(spark, texts), rate=30).where("form <> 'plain'").count()
    assert 30 <= some <= 90
    marks = ("[[pre]]", "[[suf]]", "[[mid]]")
    own = infilling.fill_in_middle(docs(spark, texts), pattern=r"\S+\s*", marks=marks).withColumn("back", infilling.restored(F.col("form"), F.col("output"), marks))
    assert [r.back for r in own.orderBy("doc_id").collect()] == texts


def test_odd_rows(spark):
    got = infilling.fill_in_middle(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    assert all(r.form == "plain" and r.output == "" and r.n == 0 for r in got if r.doc_id == 0 or r.output == "")
    assert len({r.output for r in got if r.doc_id == 4}) == 1
    assert infilling.fill_in_middle(empty(spark)).count() == 0
