"""Document graphs as they come: one by one from a finished table, and batch by batch from a stream of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def one_by_one(graphs: DataFrame) -> Iterator[dict]:
    """The rows of a table of graphs, a partition of them at a time at the driver: the first come before the last are made."""
    for row in graphs.toLocalIterator(prefetchPartitions=True):
        yield row.asDict(recursive=True)


def batches(docs: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch of a stream of documents goes through handle, which answers, resolves and renders it, and is written as JSON Lines
    in a folder of its number; a batch that is run again after a failure replaces what it left."""

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").json(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
