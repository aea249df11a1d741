"""Fill-in-the-middle: texts cut at two unit borders and put together anew, so that a model learns to write the middle last.

A Split pre-tokenizer of the tokenizers library, whose pattern's matches stand alone, gives the units' places in code points; it is a
pattern and needs no training. The number of units is the length of that array, and places in it are where a text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import table

#: Units are lines with their line feed, the last one perhaps without; the marks of prefix, suffix and middle.
LINES, MARKS = r"[^\n]*\n|[^\n]+", ("<P>", "<S>", "<M>")
#: Texts that are worked on together.
TOGETHER = 256


@cache
def _splitter(pattern: str) -> pre_tokenizers.Split:
    return pre_tokenizers.Split(Regex(pattern), "isolated")


def borders(text: str, pattern: str = LINES) -> list[int]:
    """0 and the end of each unit, in code points; of n units n + 1 numbers."""
    return [0, *(end for _, (_, end) in _splitter(pattern).pre_tokenize_str(text))]


def arranged(text: str, draws: tuple[int, int, int, int], pattern: str, rate: int, spm: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, and the new text. The first two draws choose borders, the third whether to cut, the fourth the form."""
    ends = borders(text, pattern)
    n = len(ends) - 1
    if not text or any(m in text for m in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(ends[h % (n + 1)] for h in draws[:2])
    pre, suf, mid = marks
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{suf}{text[b:]}{pre}{text[:a]}{mid}{text[a:b]}"
    return n, "psm", a, b - a, f"{pre}{text[:a]}{suf}{text[b:]}{mid}{text[a:b]}"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, pattern: str = LINES, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output for every row of docs (doc_id, text).

    `rate` of 100 texts are cut, `spm` of 100 of these have the suffix first. A null text counts as empty; empty texts and those that
    hold a mark stay as they are (plain). The draws come from the id's hash, so that rows of one id, repeated or not, and rows with a
    null id (hashed as an empty one) are cut by equal draws. Both borders may be the same: then the middle is empty. Long texts are
    read whole; an empty table gives no rows; other columns are ignored. One pass, no shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, TOGETHER):
                batch = whole_batch.slice(k, TOGETHER)
                texts, *drawn = (batch.column(j).to_pylist() for j in range(1, 6))
                made = [arranged(text, d, pattern, rate, spm, marks) for text, d in zip(texts, zip(*drawn, strict=True), strict=True)]
                columns = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True))], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *draws)
    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A marked text holds no mark, and no two marks overlap, so each is found where it was put."""
    pre, suf, mid = (F.instr(output, m) for m in marks)
    last = F.char_length(output) + 1
    part = lambda start, size, end: output.substr(start + size, end - start - size)
    p, s, m = (len(x) for x in marks)
    psm = F.concat(part(pre, p, suf), part(mid, m, last), part(suf, s, mid))
    spm = F.concat(part(pre, p, mid), part(mid, m, last), part(suf, s, pre))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
