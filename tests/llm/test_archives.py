import hashlib
import io
import struct

import pytest
import zstandard

from loomspan.llm import archives

SCHEMA = "page_id long, url string, html string, payload string, same string, path string"
LONG = "<p>" + "some words in a page " * 80


def plain(rows):
    """What each page should give, by the rule itself."""
    out = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        first = max((p for p in same if p is not None), default=None)
        response = len(body) < 1000 or page == first
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


ROWS = [
    *((k, f"http://a.example/{k}?q=a b\r\nX: 1", LONG) for k in range(40)),
    *((k, None, f"{LONG} é {k // 2}") for k in range(40, 60)),
    *((k, "u", "short") for k in range(60, 64)),
    (64, "u", None),
    (65, "u", ""),
    (None, "u", LONG),
    (None, None, None),
    (None, "u", LONG + "!"),
    (66, "u", "𝒳" * 250),
    (67, "u", "𝒳" * 250),
    (68, "u", "y" * 3_000_000),
    (39, "again", LONG),
    (5, "again", LONG),
]


def test_round_trip(spark):
    got = archives.archived(pages(spark, ROWS).repartition(5))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(ROWS)
    assert archives.archived(pages(spark, [])).count() == 0


def test_many_copies_by_a_shuffle(spark, monkeypatch):
    """Beyond SMALL groups, frequent payloads are broadcast and the others shuffled; several archives for each partition."""
    monkeypatch.setattr(archives, "SMALL", 0)
    monkeypatch.setattr(archives, "HEAVY", 4)
    assert sorted(map(tuple, archives.archived(pages(spark, ROWS)).collect()), key=str) == plain(ROWS)


def test_archives_roll_over_and_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE", 2000)
    monkeypatch.setattr(archives, "DICT_FROM", 20_000)
    folder = f"file://{tmp_path}/warc"
    rows = [(k, f"http://a/{k}", hashlib.sha512(str(k).encode()).hexdigest() * 9) for k in range(200)]
    made = archives.write_archives(archives.with_types(pages(spark, rows).coalesce(1)), folder)
    found = archives.archives_in(spark, folder)
    assert made.count() > 1 and sorted(r.path.split("/")[-1] for r in found.collect()) == sorted(r.path.split("/")[-1] for r in made.collect())
    assert made.agg({"records": "sum"}).first()[0] == 200
    read = archives.read_archives(found).collect()
    assert {(r.target_uri, bytes(r.payload).decode()) for r in read} == {(u, h) for _, u, h in rows}
    assert all(r.problem is None for r in read)


def one(page=1, body=b"<p>" + b"words " * 300, kind="response", refers=None):
    return archives.record(page, "http://x/", body, kind, refers, "2020-01-01T00:00:00Z")


def test_dictionary_plain_compressed_or_none():
    records = [one(k, f"<html><body>page {k} says some words and a number {k * k}".encode() * 20) for k in range(60)]
    words = archives.dictionary(records)
    assert words
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)).compress
    raw = struct.pack("<II", archives.DICTIONARY, len(words)) + words
    other = struct.pack("<II", 0x184D2A53, 5) + b"other"
    for head in (raw, archives.opening(words)):
        data = head + other + b"".join(map(pack, records)) + other
        assert [r for _, r in archives.frames(io.BytesIO(data))] == records
        at = [a for a, _ in archives.frames(io.BytesIO(data))]
        assert all(data[a : a + 4] == struct.pack("<I", archives.FRAME) for a in at)
    bare = zstandard.ZstdCompressor().compress
    assert [r for _, r in archives.frames(io.BytesIO(b"".join(map(bare, records))))] == records
    assert archives.dictionary(records[:3]) is None
    with pytest.raises(archives.Malformed):  # packed with a dictionary that isn't there
        list(archives.frames(io.BytesIO(b"".join(map(pack, records)))))


def test_small_reads_give_the_same(monkeypatch):
    monkeypatch.setattr(archives, "CHUNK", 7)
    records = [one(k, bytes([65 + k]) * (k * 999)) for k in range(9)]
    data = b"".join(map(zstandard.ZstdCompressor().compress, records))
    assert [r for _, r in archives.frames(io.BytesIO(data))] == records


@pytest.mark.parametrize(
    ("old", "new", "says"),
    [
        (b"WARC/1.1", b"WARX/1.1", "no WARC header"),
        (b"WARC-Date: ", b"WARC-Dote: ", "without warc-date"),
        (b"words words", b"words  words", "a block of"),
        (b"words words", b"words wordz", "digest differs"),
        (b"HTTP/1.1 200", b"HTTX/1.1 200", "digest differs"),
        (b"\r\n\r\n<p>", b"\r\n<p>\r\n\r\n", "a block of|digest differs"),
        (b"Content-Type: application", b"Content-Type application", "without a name"),
    ],
)
def test_wrong_records_are_refused(old, new, says):
    good = one()
    assert archives.parsed(good)["payload_bytes"] == 1803
    with pytest.raises(archives.Malformed, match=says):
        archives.parsed(good.replace(old, new, 1))


def test_lengths_are_checked_without_digests():
    good = b"\r\n".join(x for x in one().split(b"\r\n") if not x.startswith((b"WARC-Payload-Digest", b"WARC-Block-Digest")))
    assert archives.parsed(good)["payload_digest"] == hashlib.sha1(b"<p>" + b"words " * 300).hexdigest()
    for wrong in (good[:-1], good + b"x", good.replace(b"Content-Length: 1803", b"Content-Length: 1802"), good.replace(b"Content-Length: 1803", b"Content-Length: ?")):
        with pytest.raises(archives.Malformed):
            archives.parsed(wrong)
    with pytest.raises(archives.Malformed):
        archives.parsed(one(2, b"y" * 2000, "revisit", 1)[:-4] + b"yyyy\r\n\r\n")


def test_broken_archives_are_rows_unless_strict(spark, tmp_path):
    pack = zstandard.ZstdCompressor().compress
    good = pack(one())
    (tmp_path / "cut.warc.zst").write_bytes(good + good[:-5])
    (tmp_path / "odd.warc.zst").write_bytes(good + pack(one().replace(b"words words", b"words wordz", 1)) + good)
    (tmp_path / "junk.warc.zst").write_bytes(b"no archive")
    (tmp_path / "none.warc.zst").write_bytes(b"")
    paths = archives.archives_in(spark, f"file://{tmp_path}")
    rows = archives.read_archives(paths, strict=False).collect()
    kinds = sorted((r.path.split("/")[-1], r.problem is None) for r in rows)
    assert kinds == [("cut.warc.zst", False), ("cut.warc.zst", True), ("junk.warc.zst", False), ("odd.warc.zst", False), ("odd.warc.zst", True), ("odd.warc.zst", True)]
    with pytest.raises(Exception, match="ends within a frame|digest differs|no zstandard frame"):
        archives.read_archives(paths).collect()


def test_too_long_a_record_is_refused():
    data = zstandard.ZstdCompressor().compress(one(1, b"a" * 100_000))
    with pytest.raises(archives.Malformed, match="more than"):
        list(archives.frames(io.BytesIO(data), largest=5000))
