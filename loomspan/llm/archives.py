"""WARC archives of zstandard frames: written a record a frame, read back frame by frame, with all lengths and digests checked.

An archive may begin with a skippable frame that holds a dictionary, plain or compressed itself; all frames after it are decoded with
that. Executors write archives to the shared folder and read them as streams through Arrow's file systems.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, cut, shared_folder, stored, table

#: The skippable frame that holds a dictionary, the range of all skippable ones, and how a frame of data begins.
DICTIONARY, SKIPPABLE, FRAME = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
#: Payloads from this size on are written once; bytes of an archive after which the next is begun; a dictionary's size, and the bytes of
#: first records that it is made of; bytes of a record at most, when read; bytes read at once.
REPEATED, ARCHIVE, DICT_SIZE, DICT_FROM, LARGEST, CHUNK = 1000, 1 << 28, 1 << 15, 1 << 20, 1 << 30, 1 << 18
#: Copies of one payload beyond a share of 1 / HEAVY of all rows are joined by a broadcast, of HEAVY rows at most.
HEAVY = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Malformed(ValueError):
    """What an archive breaks, and where."""


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path as Hadoop writes it."""
    return fs.FileSystem.from_uri("file://" + uri[5:].removeprefix("//") if uri.startswith("file:") else uri)


# Records


def record_id(page: int | None, digest: str) -> str:
    """Names a page's record by its number and content, so that reruns name it alike."""
    return f"<urn:x-page:{'null' if page is None else page}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def page_of(record: str | None) -> int | None:
    """The page that a record's name holds."""
    number = (record or "").removeprefix("<urn:x-page:").split(":")[0]
    return int(number) if number.lstrip("-").isdigit() else None


def _named(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the headers alone."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page, digest.hex())),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url or "urn:unknown", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", _named(digest)),
        ("WARC-Block-Digest", _named(hashlib.sha1(block).digest())),
        *([("WARC-Refers-To", record_id(refers_to, digest.hex())), ("WARC-Profile", PROFILE)] if kind == "revisit" else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes, what: str) -> dict[str, str]:
    """Header lines by their names in lower case; a line that begins with a blank goes on with the one before."""
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Malformed(f"{what} line without a name: {line[:80]!r}")
        last = name.lower()
        found[last] = value.strip()
    return found


def _length(fields: dict[str, str], what: str) -> int:
    text = fields.get("content-length", "")
    if not (text.isascii() and text.isdigit()):
        raise Malformed(f"{what} without a length")
    return int(text)


def _same(said: str | None, data: bytes, what: str) -> None:
    """A sha1 digest, in base 32 or hexadecimal, against the data; other algorithms aren't checked."""
    name, _, value = (said or "").partition(":")
    if name.lower() == "sha1" and value.lower() not in (hashlib.sha1(data).hexdigest(), base64.b32encode(hashlib.sha1(data).digest()).decode().lower()):
        raise Malformed(f"{what} digest differs")


def _hexadecimal(said: str | None) -> str | None:
    value = (said or "").partition(":")[2]
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower() or None
    except binascii.Error as e:
        raise Malformed(f"digest that is none: {value!r}") from e


def parsed(data: bytes) -> dict:
    """A record's fields and payload, once everything that it says about itself is found to hold."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not version.startswith(b"WARC/1.") or not blank:
        raise Malformed("no WARC header")
    fields = _fields(lines, "header")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not fields.get(name):
            raise Malformed(f"header without {name}")
    n = _length(fields, "header")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Malformed(f"a block of {n} bytes in {len(rest) - 4}")
    block, kind = rest[:n], fields["warc-type"]
    _same(fields.get("warc-block-digest"), block, "block")
    payload, size = block, n
    if fields.get("content-type", "").startswith("application/http") and kind in ("response", "revisit"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        status, _, lines = http.partition(b"\r\n")
        if not status.startswith(b"HTTP/") or not blank:
            raise Malformed("no HTTP header")
        said = _fields(lines, "HTTP header") if lines else {}
        size = _length(said, "HTTP header") if "content-length" in said else len(payload)
        if len(payload) != (size if kind == "response" else 0):
            raise Malformed(f"a payload of {size} bytes in {len(payload)}")
    if kind == "response":
        _same(fields.get("warc-payload-digest"), payload, "payload")
    digest = _hexadecimal(fields.get("warc-payload-digest")) or hashlib.sha1(payload).hexdigest()
    return {
        "record_id": fields["warc-record-id"],
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload if kind == "response" else None,
    }


# Frames


def dictionary(first: list[bytes]) -> bytes | None:
    """A dictionary made of an archive's first records, or none where they are too few."""
    try:
        return zstandard.train_dictionary(DICT_SIZE, first).as_bytes() if len(first) > 7 else None
    except zstandard.ZstdError:
        return None


def opening(words: bytes) -> bytes:
    """The frame that carries a dictionary, compressed."""
    packed = zstandard.ZstdCompressor().compress(words)
    return struct.pack("<II", DICTIONARY, len(packed)) + packed


def frames(source, largest: int = LARGEST) -> Iterator[tuple[int, bytes]]:
    """Each frame of data in an open stream, decoded: where it begins, and its bytes. Only a part of the stream is held at a time."""
    decoder, held, at, first = zstandard.ZstdDecompressor(), b"", 0, True

    def more(n: int) -> bytes:
        nonlocal held
        while len(held) < n and (part := source.read(max(CHUNK, n - len(held)))):
            held += part
        return held[:n]

    while more(4):
        if len(more(8)) < 8:
            raise Malformed("the archive ends within a frame")
        magic, size = struct.unpack("<II", held[:8])
        if magic in SKIPPABLE:
            if len(more(8 + size)) < 8 + size:
                raise Malformed("the archive ends within a skippable frame")
            if magic == DICTIONARY and first:
                words = held[8 : 8 + size]
                if words[:4] == struct.pack("<I", FRAME):
                    words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            held, at, first = held[8 + size :], at + 8 + size, False
            continue
        if magic != FRAME:
            raise Malformed("no zstandard frame")
        one, out, read, size = decoder.decompressobj(), [], 0, 0
        try:
            while not one.eof:
                if not more(1):
                    raise Malformed("the archive ends within a frame")
                out.append(one.decompress(held))
                read += len(held)
                held = one.unused_data if one.eof else b""
                size += len(out[-1])
                if size > largest:
                    raise Malformed(f"a record of more than {largest} bytes")
        except zstandard.ZstdError as e:
            raise Malformed(str(e)) from e
        yield at, b"".join(out)
        at, first = at + read - len(held), False


# Jobs


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, record_type and refers_to of every page (page_id, url, html).

    Of pages whose payloads are equal and have REPEATED bytes at least, that with the largest id is the response. Payloads travel only
    where more than SMALL of them have copies, and then those of frequent ones don't.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= REPEATED, F.sha2("payload", 256)))
    groups = stored(rows.where("same is not null").groupBy("same").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("leader")).where("copies > 1"))
    n, copies = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if n <= SMALL:
        led = rows.join(F.broadcast(groups.drop("copies")), "same", "left")
    else:
        often = F.col("copies") > max(REPEATED, copies // HEAVY)
        led = rows.join(F.broadcast(groups.where(often).select("same", F.col("leader").alias("often"))), "same", "left")
        # what needs no partner any more is spread by a key of its own
        led = led.withColumn("key", F.when(F.col("same").isNotNull() & F.col("often").isNull(), F.col("same")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
        led = led.join(groups.where(~often).select(F.col("same").alias("key"), "leader"), "key", "left").withColumn("leader", F.coalesce("often", "leader"))
    own = F.col("leader").isNull() | F.col("leader").eqNullSafe(F.col("page_id"))
    return led.select("page_id", "url", "payload", F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("leader")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Writes records (page_id, url, payload, record_type, refers_to) into archives of the folder; returns path, records and bytes of each.

    Each partition writes its own, one after the other, under names that no other attempt takes; an archive has its name once it is
    whole. What a lost attempt leaves isn't in the table returned, which is written itself.
    """
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _filesystem(folder)
        system.create_dir(place, recursive=True)
        made: list[tuple[str, int, int]] = []
        pending = (record(*(batch.column(k)[j].as_py() for k in range(5)), when) for batch in batches for j in range(batch.num_rows))
        first = next(pending, None)
        while first is not None:
            start, size = [first], len(first)
            while size < DICT_FROM and (one := next(pending, None)) is not None:
                start.append(one)
                size += len(one)
            words = dictionary(start)
            packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True)
            name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4()}.warc.zst"
            n, size = 0, 0
            with system.open_output_stream(f"{place}/_{name}", compression=None) as out:
                if words:
                    size += out.write(opening(words))
                for one in start:
                    size += out.write(packer.compress(one))
                    n += 1
                first = None
                for one in pending:
                    if size >= ARCHIVE:
                        first = one
                        break
                    size += out.write(packer.compress(one))
                    n += 1
            system.move(f"{place}/_{name}", f"{place}/{name}")
            made.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(write, "path string, records long, bytes long"))


RECORDS = "path string, offset long, record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary, problem string"


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """path of all archives of a folder, as Spark lists them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def read_archives(paths: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """A row for each record of the archives (path): its place, fields and payload.

    Each frame holds one record. A record that says wrong things about itself fails the job; unless strict, it is a row with the problem
    and no fields, and where frames can't be told apart any more that row is the archive's last. Revisits have no payload, but the size and digest
    of what they stand for. An empty archive or table gives no rows. One archive is one stream; they are dealt out evenly.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), *(pa.string(),) * 5, pa.int64(), pa.binary(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(path: str, at: int, e: Malformed) -> dict:
            if strict:
                raise Malformed(f"{path}, {at}: {e}") from e
            return {"path": path, "offset": at, "problem": str(e)}

        def rows() -> Iterator[dict]:
            for path in (p.as_py() for batch in batches for p in batch.column(0)):
                system, place = _filesystem(path)
                with system.open_input_stream(place, compression=None) as source:
                    decoded, at = frames(source), 0
                    while True:
                        try:
                            at, data = next(decoded, (None, b""))
                        except Malformed as e:
                            yield told(path, at, e)
                            break
                        if at is None:
                            break
                        try:
                            row = {"path": path, "offset": at} | parsed(data)
                        except Malformed as e:
                            row = told(path, at, e)
                        yield row

        held, size = [], 0
        for row in rows():
            held.append(row)
            size += len(row.get("payload") or b"") + 500
            if not payloads:
                row["payload"] = None
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return paths.select("path").mapInArrow(read, RECORDS)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page (page_id, url, html), as read back from archives of them.

    A null html is an empty payload; payloads under REPEATED bytes are all responses, equal or not. A null id is less than all ids and is
    refers_to of none but null ones. Rows that repeat the id that a group of equal payloads refers to are responses, all of them.
    A null or odd url is written as a URI; long pages are one frame like others; extra columns are ignored; an empty table gives no
    archive and no rows. Archives stay in the folder, by default a new one in the shared folder.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4()}"
    found = read_archives(write_archives(with_types(pages), folder), payloads=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+):", 1).try_cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))
