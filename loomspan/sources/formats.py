"""Data sources of the session: document graphs ("jgf") and files named by their rows ("named_files").

    register(spark)
    spark.read.format("jgf").load(path)
    graphs.write.format("jgf").mode("append").save(path)
    prompts.write.format("named_files").mode("overwrite").save(path)

Tasks write into a staging folder of the job below the path; what is there moves to its place when the job commits and is removed when it
fails, so that a failed job leaves nothing and a repeated task nothing twice. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a graph: its nodes, then its edges (src and dst are null for nodes).
GRAPH_ROWS = "doc_id string, kind string, id string, label string, src string, dst string, relation string, directed boolean, metadata map<string, string>"
#: Bytes of a file that one task reads, about; files that move at once.
RANGE, AT_ONCE = 64 << 20, 16


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Hadoop writes it; a path without a scheme is a local one."""
    if uri.startswith("file:"):
        uri = "file://" + uri[5:].removeprefix("//")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), posixpath.abspath(uri))


def files_in(system: fs.FileSystem, place: str) -> list[fs.FileInfo]:
    """The files at a place or below it, in order; what begins with _ or . is none."""
    if system.get_file_info(place).type == fs.FileType.File:
        return [system.get_file_info(place)]
    found = system.get_file_info(fs.FileSelector(place, recursive=True))
    shown = lambda f: not any(p.startswith(("_", ".")) for p in f.path[len(place) :].split("/") if p)
    return sorted((f for f in found if f.type == fs.FileType.File and shown(f)), key=lambda f: f.path)


# --- staging ---


@dataclass
class Staged(WriterCommitMessage):
    names: list[str]


class StagedWriter(DataSourceWriter):
    """Files that tasks stage under the job's own folder; `contents` says which, as (name, bytes)."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_staging-{uuid.uuid4()}"
        system, place = filesystem(path)
        system.create_dir(f"{place}/{self.job}", recursive=True)  # a task that outlives a failed job finds it gone, and ends

    def contents(self, rows: Iterator) -> Iterable[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Staged:
        system, place = filesystem(self.path)
        task = TaskContext.get()
        own = f"{place}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(own, recursive=False)
        names = []
        for name, data in self.contents(iterator):
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no name of a file: {name!r}")
            with system.open_output_stream(f"{own}/{name}", compression=None) as out:
                out.write(data)
            names.append(f"{own[len(place) + 1 :]}/{name}")
        return Staged(names)

    def commit(self, messages: list[Staged | None]) -> None:
        system, place = filesystem(self.path)
        staged = [name for m in messages if m for name in m.names]
        last = [posixpath.basename(name) for name in staged]
        if len(set(last)) < len(last):
            self.abort(messages)
            raise ValueError(f"files of the same name: {sorted({n for n in last if last.count(n) > 1})[:3]}")
        if self.overwrite:
            for f in files_in(system, place):
                system.delete_file(f.path)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda pair: system.move(f"{place}/{pair[0]}", f"{place}/{pair[1]}"), zip(staged, last, strict=True)))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """What is staged goes, whatever has become of it."""
        system, place = filesystem(self.path)
        for last in (False, False, True):
            try:
                if system.get_file_info(f"{place}/{self.job}").type == fs.FileType.Directory:
                    system.delete_dir(f"{place}/{self.job}")
                return
            except OSError:  # a task that is being ended still writes there
                if last:
                    raise
                time.sleep(1)


# --- graphs ---


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class GraphReader(DataSourceReader):
    """Graphs, one a line: a task has those whose line begins in its range of a file. With multiline, a file is one graph."""

    def __init__(self, path: str, multiline: bool):
        self.path, self.multiline = path, multiline

    def partitions(self) -> list[Part]:
        system, place = filesystem(self.path)
        step = 1 << 62 if self.multiline else RANGE
        return [Part(f.path, a, min(a + step, f.size)) for f in files_in(system, place) for a in range(0, f.size, step)] or [Part("", 0, 0)]

    def lines(self, part: Part) -> Iterator[bytes]:
        system, _ = filesystem(self.path)
        if not part.path:
            return
        with system.open_input_file(part.path) as source:
            if self.multiline:
                yield source.read()
                return
            at = max(0, part.start - 1)  # the line break before the range tells whether a line begins with it
            source.seek(at)
            held = b""
            if part.start:
                while (cut := held.find(b"\n")) < 0:
                    if not (more := source.read(1 << 16)):
                        return
                    at, held = at + len(held), more
                at, held = at + cut + 1, held[cut + 1 :]
            while at < part.end:
                while (cut := held.find(b"\n")) < 0 and (more := source.read(1 << 20)):
                    held += more
                line = held if cut < 0 else held[:cut]
                if line.strip():
                    yield line
                if cut < 0:
                    return
                at, held = at + cut + 1, held[cut + 1 :]

    def read(self, partition: Part) -> Iterator[tuple]:
        for line in self.lines(partition):
            graph = json.loads(line)["graph"]
            doc = graph.get("id")
            for i, node in graph.get("nodes", {}).items():
                yield doc, "node", i, node.get("label"), None, None, None, None, node.get("metadata") or {}
            for edge in graph.get("edges", []):
                yield doc, "edge", edge.get("id"), edge.get("label"), edge["source"], edge["target"], edge.get("relation"), edge.get("directed"), edge.get("metadata") or {}


class GraphWriter(StagedWriter):
    """Rows of graphs, those of a graph one after the other; a file for each task, or with per_document one for each graph."""

    def __init__(self, path: str, overwrite: bool, per_document: bool):
        super().__init__(path, overwrite)
        self.per_document = per_document

    def graphs(self, rows: Iterator) -> Iterator[tuple[str, str]]:
        seen: set = set()
        for doc, own in groupby(rows, key=lambda r: r["doc_id"]):
            if doc in seen:
                raise ValueError(f"the rows of graph {doc} don't follow each other")
            seen.add(doc)
            nodes, edges = {}, []
            for r in own:
                text = {k: v for k, v in (r["metadata"] or {}).items() if v is not None}
                if r["kind"] == "node":
                    nodes[r["id"]] = {"label": r["label"], "metadata": text}
                else:
                    edges.append({"id": r["id"], "source": r["src"], "target": r["dst"], "relation": r["relation"], "directed": r["directed"], "label": r["label"], "metadata": text})
            yield doc, json.dumps({"graph": {"id": doc, "label": doc, "directed": True, "type": "knowledge graph", "metadata": {"version": "2"}, "nodes": nodes, "edges": edges}}, ensure_ascii=False)

    def contents(self, rows: Iterator) -> Iterable[tuple[str, bytes]]:
        if self.per_document:
            yield from ((f"{str(doc).replace('/', '_').replace('#', '_')}.jgf.json", value.encode()) for doc, value in self.graphs(rows))
            return
        lines = "".join(f"{value}\n" for _, value in self.graphs(rows))
        if lines:
            yield f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4()}.jgf.jsonl", lines.encode()


def _on(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class JsonGraphs(DataSource):
    """JSON Graph Format. Options: path, multiline (reading), per_document (writing)."""

    @classmethod
    def name(cls) -> str:
        return "jgf"

    def schema(self) -> str:
        return GRAPH_ROWS

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options["path"], _on(self.options, "multiline"))

    def writer(self, schema, overwrite: bool) -> GraphWriter:
        return GraphWriter(self.options["path"], overwrite, _on(self.options, "per_document"))


class NamedWriter(StagedWriter):
    def contents(self, rows: Iterator) -> Iterable[tuple[str, bytes]]:
        return ((r["file_name"], (r["value"] or "").encode()) for r in rows)


class NamedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        system, place = filesystem(self.path)
        return [Part(f.path, 0, f.size) for f in files_in(system, place)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.path:
            system, _ = filesystem(self.path)
            with system.open_input_stream(partition.path, compression=None) as source:
                yield posixpath.basename(partition.path), source.read().decode()


class NamedFiles(DataSource):
    """A file for each row, with the row's value in it and its name; no folders. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file_name string, value string"

    def reader(self, schema) -> NamedReader:
        return NamedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    for source in (JsonGraphs, NamedFiles):
        spark.dataSource.register(source)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as sources.graph.nodes_and_edges makes them -> the rows of their graphs, those of a graph together."""
    doc = F.col("doc_id").cast("string").alias("doc_id")
    null = lambda t: F.lit(None).cast(t)
    n = nodes.select(doc, F.lit("node").alias("kind"), "id", "label", null("string").alias("src"), null("string").alias("dst"), null("string").alias("relation"), null("boolean").alias("directed"), "metadata")
    e = edges.select(doc, F.lit("edge").alias("kind"), "id", F.col("relation").alias("label"), "src", "dst", "relation", "directed", "metadata")
    return n.unionByName(e).repartition("doc_id").sortWithinPartitions("doc_id", F.desc("kind"), "id")
