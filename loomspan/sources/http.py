"""Proposers that run elsewhere: completions over HTTP, replayed answers, and a rule-based one that needs no model."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ask = Callable[[str], str]


def completions(url: str, model: str, max_tokens: int = 2048, timeout: float = 600.0, grammar: str | None = None) -> Ask:
    """Asks a completions service; temperature 0."""

    def ask(prompt: str) -> str:
        body = {"model": model, "prompt": prompt, "temperature": 0, "max_tokens": max_tokens} | ({"guided_grammar": grammar} if grammar else {})
        request = urllib.request.Request(f"{url}/v1/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            choice = json.load(answer)["choices"][0]
        if choice.get("finish_reason") not in ("stop", "length"):
            raise RuntimeError(f"unfinished: {choice.get('finish_reason')}")
        return choice["text"]

    return ask


def asked(prompts: DataFrame, ask: Ask, partitions: int | None = None, in_flight: int = 32, by_length: bool = False) -> DataFrame:
    """Prompts (chunk_id, prompt) -> chunk_id, raw, error; in_flight requests a task at a time. A failing request fails its row alone.

    by_length deals prompts of like length to a partition, the longest first, so that requests in flight take about as long.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return ask(prompt or ""), None
        except Exception as e:  # the row says why
            return None, f"{type(e).__name__}: {e}"[:120]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                found = list(pool.map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["chunk_id", "raw", "error"])

    df = prompts.select("chunk_id", "prompt")
    if by_length:
        size = F.char_length(F.coalesce("prompt", F.lit("")))
        parts = (partitions,) if partitions else ()
        df = df.withColumn("_size", size).repartitionByRange(*parts, F.desc("_size")).sortWithinPartitions(F.desc("_size")).drop("_size")
    elif partitions:
        df = df.repartition(partitions)
    return df.mapInArrow(run, "chunk_id string, raw string, error string")


def replayed(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that a table holds already (chunk_id, raw), null where it has none."""
    return chunks.join(answers.select("chunk_id", "raw"), "chunk_id", "left")


def generated(chunks: DataFrame, ask: Ask, schema: str = "business", fmt: str = "sentences", style: str = "full", template: Callable[[list[dict]], str] | None = None, repair: bool = False, partitions: int | None = None) -> DataFrame:
    """A chunk table (chunk_id, text) asked and answered in one call: the records that sources.files.write_results writes.

    Every chunk has a record: one whose request failed says why in error. template turns a chat into a prompt; by default its turns one below the other.
    """
    from ..operators import answers, exports
    from ..operators.rows import flat_map, written
    from . import files

    plain = template or (lambda chat: "\n\n".join(turn["content"] for turn in chat))
    told = exports.chats(chunks.select("chunk_id", "text", F.lit(None).cast("string").alias("known")), fmt, schema, style)
    prompts = flat_map(told, ["chunk_id"], ["messages"], lambda m: [(plain([dict(x.asDict() if hasattr(x, "asDict") else x) for x in m]),)], "prompt string")
    said = written(asked(prompts, ask, partitions, by_length=True).withColumnRenamed("error", "_failed"))  # each is asked once
    made = chunks.select("chunk_id", "text").join(said, "chunk_id").withColumns({"fmt": F.lit(fmt), "schema": F.lit(schema), "seconds": F.lit(0.0)})
    results = answers.results(made, repair).join(said.select("chunk_id", "_failed"), "chunk_id").withColumn("error", F.coalesce("_failed", "error")).drop("_failed")
    return files.result_records(results, made.withColumn("raw", F.coalesce("raw", F.lit(""))))
