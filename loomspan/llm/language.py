"""Language identification by a bit-sliced Bloom filter of character n-grams.

Each slot of the filter is a mask with one bit for each language, so one lookup of an n-gram returns all languages that hold
it. A language's score is the share of a text's n-grams that its bit survives for, corrected for its false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

#: Documents of each language that the filter learns from, about; slots of the filter; lookups for each n-gram; the least share of a
#: language's n-grams that one must have to be held (so at most 1 / LEAST are held).
SAMPLE, SLOTS, LOOKUPS, LEAST, N = 4000, 1 << 18, 3, 5e-5, 3
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in lower case, the n-grams as numbers, the text of each, and how many letters each text has. What is no letter is a blank; n-grams without a letter don't count."""
    codes = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
    letter = _letters()[codes]
    n_letters = np.bincount(of, weights=letter, minlength=len(texts)).astype(np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    grams = np.zeros(max(0, len(codes) - N + 1), np.uint64)
    for k in range(N):
        grams = grams << np.uint64(21) | codes[k : k + len(grams)]
    own = (of[: len(grams)] == of[N - 1 :]) & letter[N // 2 : N // 2 + len(grams)] if len(grams) else np.zeros(0, bool)
    return grams[own], of[: len(grams)][own], n_letters


def slots(grams: np.ndarray, k: int) -> np.ndarray:
    return (grams * np.uint64(MIXERS[k]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


@dataclass
class Filter:
    langs: list[str]
    masks: np.ndarray  # a row of 64-bit words for each slot
    false: np.ndarray  # each language's share of false positives

    @classmethod
    def of(cls, held: dict[str, np.ndarray]) -> Filter:
        """held: the n-grams of each language; the first language is the fallback."""
        langs = list(held)
        masks = np.zeros((SLOTS, max(1, (len(langs) + 63) // 64)), np.uint64)
        for k, lang in enumerate(langs):
            for j in range(LOOKUPS):
                masks[slots(held[lang], j), k // 64] |= np.uint64(1) << np.uint64(k % 64)
        fill = np.array([np.mean(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(langs))])
        return cls(langs, masks, fill**LOOKUPS)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language (und without a letter, or if none was learnt) and its share of all languages' corrected scores."""
        grams, of, letters = ngrams([t or "" for t in texts])
        n = np.maximum(1, np.bincount(of, minlength=len(texts)))
        score = np.zeros((len(texts), max(1, len(self.langs))))
        for word in range(self.masks.shape[1]):
            found = self.masks[slots(grams, 0), word]
            for j in range(1, LOOKUPS):
                found = found & self.masks[slots(grams, j), word]
            for k in range(64 * word, min(len(self.langs), 64 * word + 64)):
                hits = np.bincount(of, weights=(found >> np.uint64(k % 64) & np.uint64(1)).astype(np.float64), minlength=len(texts))
                score[:, k] = np.maximum(0, (hits / n - self.false[k]) / (1 - self.false[k]))
        best, total = score.argmax(1), score.sum(1)
        known = (letters > 0) & bool(self.langs)
        share = np.where(known & (total > 0), score[np.arange(len(texts)), best] / np.maximum(total, 1e-12), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.clip(share, 0, 1)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """The filter of labelled rows (doc_id, text, lang): about `sample` rows of each language, chosen by a hash of the id, count
    n-grams on the executors; at most 1 / LEAST n-grams of each language come back."""
    labelled = docs.where("lang is not null and text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")
    sizes = dict(docs.where("lang is not null and text is not null").groupBy("lang").count().collect())  # a row for each language
    if not sizes:
        return Filter.of({})
    part = F.pmod("h", F.lit(1 << 30))
    upto = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << 30, int(sample / n * (1 << 30)) + 1)))))
    chosen = labelled.where(part < upto[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, inverse = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            grams, of, _ = ngrams(batch.column(1).to_pylist())
            for k, name in enumerate(names):
                own, n = np.unique(grams[inverse[of] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(own)), pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    held = counts.join(totals, "lang").where(F.col("n") >= LEAST * F.col("total")).select("lang", "gram").orderBy("lang", "gram").toPandas()
    order = sorted(held.lang.unique(), key=lambda k: (-sizes[k], k))
    return Filter.of({k: held.gram[held.lang == k].to_numpy(np.int64).astype(np.uint64) for k in order})


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs (doc_id, text, lang).

    Rows whose crc32(doc_id as text) mod 3 is not 1 and whose lang is not null are learnt from; predictions see the text alone.
    Null, empty and letterless texts are und with score 0; a text none of whose n-grams is known gets the most frequent
    language with score 0. A null id counts as not held out. Repeated rows are predicted each; an empty table gives no rows.
    Other columns are ignored.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn(docs.select("doc_id", "text", "lang").where(~out), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for each 64 languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(k, 500)
                texts = batch.column(2).to_pylist()
                names, scores = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), out.alias("held_out"), whole().alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
