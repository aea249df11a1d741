"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies; no ids are made.

Documents go in blocks. A block's pre-tokens that are no piece themselves are packed by hash bucket: each bucket's row has the
distinct ones of the block and, for each, the block's documents and frequencies. The exchange by bucket brings equal
pre-tokens of all blocks together, so that each is counted once; what comes back is one number per block, bucket and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scaled, table, whole

#: Documents of a block, and the characters after which it ends early. A longer text is a block of its own.
BLOCK_DOCS, BLOCK_CHARS = 2000, 6_000_000
#: Pre-tokens whose counts a task keeps; beyond them it forgets all and counts anew, which changes no result.
KNOWN = 400_000
TOKENIZER = "byte_bpe_50k.json"

_loaded: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    """The tokenizer, its pre-token pattern, the strings that it takes as one token wherever they are, and its pre-tokens of one piece."""
    if path not in _loaded:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        split = regex.compile("|".join(map(regex.escape, special))) if special else None
        pattern = regex.compile(public_tokenizers.PATTERN)
        decoder = tok.decoder
        pieces = [s for t in tok.get_vocab(with_added_tokens=False) if "�" not in (s := decoder.decode([t]))]
        single = frozenset(s for s, e in zip(pieces, tok.encode_batch(pieces, add_special_tokens=False), strict=True) if len(e.ids) == 1)
        _loaded[path] = tok, pattern, split, single
    return _loaded[path]


def block_bucket(block: int, buckets: int) -> int:
    """A block's number has its task's in the upper half; both count, so that all buckets get as many."""
    return ((block >> 32) * 1_000_003 + (block & 0xFFFFFFFF)) % buckets


def _pack(block: int, texts: list[str], buckets: int, path: str) -> Iterator[tuple]:
    """(block, bucket, pre-tokens, how many documents each is in, the documents' places in the block, frequencies). A row without pre-tokens has the counts known at once; such rows are dealt to all buckets by their block's number."""
    _, pattern, special, single = _tokenizer(path)
    known = np.zeros(len(texts), np.int64)
    found, of = [], []
    for i, text in enumerate(texts):
        if special and special.search(text):
            known[i] += len(special.findall(text))
            pre = list(chain.from_iterable(pattern.findall(x) for x in special.split(text)))
        else:
            pre = pattern.findall(text)
        found += pre
        of.append(len(pre))
    docs = np.repeat(np.arange(len(texts)), of)
    if found:
        codes, names = pd.factorize(np.array(found, dtype=object))
        one = np.fromiter((x in single for x in names), bool, len(names))
        known += np.bincount(docs[one[codes]], minlength=len(texts))
        rest = ~one[codes]
        pairs, times = np.unique(codes[rest].astype(np.int64) * len(texts) + docs[rest], return_counts=True)
        codes, docs = pairs // len(texts), pairs % len(texts)
        bucket = (pd.util.hash_array(names, categorize=False) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket[codes], kind="stable")
        codes, docs, times = codes[order], docs[order], times[order]
        ends = np.searchsorted(bucket[codes], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(ends[b], ends[b + 1])
            first = np.flatnonzero(np.r_[True, np.diff(codes[own]) != 0])
            widths = np.diff(np.r_[first, len(codes[own])])
            yield block, b, list(names[codes[own][first]]), widths.astype("<u2").tobytes(), docs[own].astype("<u2").tobytes(), times[own].astype("<u4").tobytes()
    yield block, block_bucket(block, buckets), None, b"", np.arange(len(texts)).astype("<u2").tobytes(), known.astype("<i8").tobytes()


PACKED = "block long, bucket int, names array<string>, widths binary, docs binary, times binary"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) for every row of docs (doc_id, text).

    Counts are those of the tokenizer file without special tokens added; its special strings inside a text count one each.
    Null texts count as empty: 0 bytes and tokens. Repeated rows and ids are counted each; an empty table gives no rows.
    Other columns are ignored.
    """
    path = path or tokenizer_path()
    buckets = scaled(docs, 16)
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("names", pa.list_(pa.string())), ("widths", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def out():
            rows = list(_pack((part << 32) + n, texts, buckets, path))
            last = len(rows) - 1
            columns = [[r[k] for r in rows] for k in range(6)]
            columns += [[ids if k == last else None for k in range(len(rows))], [[len(t.encode()) for t in texts] if k == last else None for k in range(len(rows))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if len(ids) == BLOCK_DOCS or size >= BLOCK_CHARS:
                    yield out()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)[0]
        known: dict[str, int] = {}
        for batch in batches:
            blocks, places, sums = [], [], []
            names_of, widths_of, docs_of, times_of = (batch.column(k) for k in (2, 3, 4, 5))
            for k, block in enumerate(batch.column(0).to_pylist()):
                at, times = np.frombuffer(docs_of[k].as_py(), "<u2").astype(np.int64), times_of[k].as_py()
                if not names_of[k].is_valid:
                    total = np.frombuffer(times, "<i8")
                else:
                    names = names_of[k].as_py()
                    new = [x for x in names if x not in known]
                    known.update((x, len(e)) for x, e in zip(new, tok.encode_batch(new, add_special_tokens=False), strict=True))
                    pieces = np.fromiter((known[x] for x in names), np.int64, len(names))
                    each = np.repeat(pieces, np.frombuffer(widths_of[k].as_py(), "<u2")) * np.frombuffer(times, "<u4")
                    total = np.bincount(at, weights=each).astype(np.int64)
                    at = np.flatnonzero(total)
                    total = total[at]
                    if len(known) > KNOWN:
                        known.clear()
                blocks.append(block)
                places.append(at.astype("<u2").tobytes())
                sums.append(total.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.binary()), pa.array(sums, pa.binary()), batch.column(6), batch.column(7)], names=["block", "docs", "sums", "ids", "bytes"])

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids, sizes = np.zeros(BLOCK_DOCS, np.int64), [], []
        for batch in groups:
            for k in range(batch.num_rows):
                total[np.frombuffer(batch.column(1)[k].as_py(), "<u2")] += np.frombuffer(batch.column(2)[k].as_py(), "<i8")
                if batch.column(3)[k].is_valid:
                    ids, sizes = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(total[: len(ids)])], names=["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    packed = texts.mapInArrow(pack, PACKED + ", ids array<long>, bytes array<long>")
    counted = packed.repartition(buckets, "bucket").mapInArrow(count, "block long, docs binary, sums binary, ids array<long>, bytes array<long>")
    done = counted.groupBy("block").applyInArrow(add, "doc_id long, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
