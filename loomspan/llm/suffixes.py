"""Removal of repeated passages by distributed prefix doubling.

A rank is the name of a position's prefix of some length; the name at twice the length comes from the pair of names (at the
position, at the offset). Names are 64-bit fingerprints of those pairs, so that pairs need no global numbering. Ranks of all
positions would be more than ten times the text, so the first sort takes the positions that are least in some window: every
50-byte string holds one, and equal strings hold it at the same place.

- Spark sorts the names at length 20 with those of the 80 bytes around; neighbours show which 20-byte prefixes are in one document
  only, and those go. Most others are settled by the longer rank: all but its first document lose the 50-byte strings in it.
- Positions whose longer rank is new, while the shorter one isn't, are ranked at length 35, here and 15 bytes ahead: every
  50-byte string around a position holds one of the two. Those that are in one document only go.
- What is left is ranked at length 50, the threshold.

Equal texts count once: their first document alone enters the first sort. Within a block of documents, equal ranks are put
together before they are sorted, so that a passage in very many documents gives one row for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stored, table, whole

#: Bytes of a string that must not repeat; of the first rank. BEFORE bytes ahead of a position and LENGTH after it hold all its strings.
LENGTH, FIRST = 50, 20
BEFORE = LENGTH - FIRST
AROUND = BEFORE + LENGTH
#: Bytes of the middle rank. A string that starts up to REST bytes ahead of its position holds the MIDDLE bytes from it on; any other holds those from REST bytes ahead on.
REST = BEFORE // 2
MIDDLE = LENGTH - REST
#: Bytes of a block's documents, about (a longer document is held whole), and the bytes that are ranked at a time within one.
BLOCK_BYTES, CHUNK = 1 << 22, 1 << 17
#: Bits of the first name, which only sorts out what is unique, and of the name of the bytes around, which tells apart positions of one first name.
SHORT, LONG = np.uint64((1 << 48) - 1), np.uint64((1 << 56) - 1)
STEP = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(50)
#: Names at length 1; the last is of what lies outside a document.
SYMBOLS = _rng.integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = {2**k: np.uint64(pow(STEP, 2**k, 1 << 64)) for k in range(8)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x


class Names:
    """The names of all positions of some texts, which lie in one buffer with gaps, at any length up to 127."""

    def __init__(self, texts: list[bytes]):
        self.begin = np.zeros(len(texts), np.int64)
        self.size = np.array([len(t) for t in texts], np.int64)
        total = int(self.size.sum()) + AROUND * (len(texts) + 1)
        symbols = np.full(total, 256, np.int16)
        at = AROUND
        for k, t in enumerate(texts):
            symbols[at : at + len(t)] = np.frombuffer(t, np.uint8)
            self.begin[k] = at
            at += len(t) + AROUND
        self.levels = {1: SYMBOLS[symbols]}

    def level(self, length: int) -> np.ndarray:
        """At a power of two: the pair of names (here, half the length on)."""
        if length not in self.levels:
            half = self.level(length // 2)
            x = half[: len(half) - length // 2] * SHIFTS[length // 2]
            x += half[length // 2 :]
            self.levels[length] = x
        return self.levels[length]

    def at(self, length: int, positions: np.ndarray) -> np.ndarray:
        """At any length, for some positions: its powers of two joined, and mixed."""
        out, on = np.zeros(len(positions), np.uint64), 0
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                out = out * SHIFTS[1 << k] + self.level(1 << k)[positions + on]
                on += 1 << k
        return _mixed(out)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions, text of each, first and last start of the 50-byte strings that each is the least position of). Ties go to the left."""
        whole_, n = self.level(16), len(self.level(1))
        rest = FIRST - 16
        first = whole_[: n - FIRST + 1] * SHIFTS[rest] + self.level(rest)[16 : 16 + n - FIRST + 1]
        key = _mixed(first)
        key &= np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(len(key), dtype=np.uint64)
        span, width = key, 1
        while 2 * width <= BEFORE + 1:
            span = np.minimum(span[:-width], span[width:])
            width *= 2
        if rest := BEFORE + 1 - width:
            span = np.minimum(span[:-rest], span[rest:])
        starts = np.concatenate([np.arange(b, b + s - LENGTH + 1) for b, s in zip(self.begin, self.size, strict=True) if s >= LENGTH] or [np.zeros(0, np.int64)])
        owner = (span[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(owner):
            return (np.zeros(0, np.int64),) * 4
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        last = np.r_[new[1:], len(owner)] - 1
        positions = owner[new]
        return positions, np.searchsorted(self.begin, positions, "right") - 1, starts[new], starts[last]


def chunks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (…, bytes) in parts of CHUNK bytes about, so that the arrays of a part stay in a processor's cache."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def ranked(part: list[tuple]):
    """The least positions of a part with both names."""
    names = Names([r[-1] for r in part])
    positions, of, first, last = names.least()
    return names, positions, of, first, last, names.at(FIRST, positions) & SHORT, names.at(AROUND, positions - BEFORE) & LONG


def _block_ranks(texts: pa.Table, firsts: pa.Table) -> pa.Table:
    """Per block: both names of the least positions of texts that come first among equal ones, and the first document of each pair, and how much larger the last one is."""
    own = set(zip(firsts.column("doc_id").to_pylist(), firsts.column("digest").to_pylist(), strict=True))
    rows = []
    for i, d, t in zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), texts.column("text").to_pylist(), strict=True):
        if (i, d) in own:
            own.discard((i, d))
            rows.append((i, t.encode()))
    one, two, ids = [], [], []
    for part in chunks(rows):
        _, _, of, _, _, short, long = ranked(part)
        one.append(short)
        two.append(long)
        ids.append(np.array([r[0] for r in part], np.int64)[of])
    names = ["short", "long", "block", "low", "more"]
    if not one:
        return pa.table({k: pa.array([], pa.int64()) for k in names})
    one, two, ids = map(np.concatenate, (one, two, ids))
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)])
    last = np.r_[new[1:], len(one)] - 1 if len(one) else new
    block = np.full(len(new), texts.column("block")[0].as_py() if texts.num_rows else 0, np.int64)
    return pa.table(dict(zip(names, (one[new].view(np.int64), two[new].view(np.int64), block, ids[new], ids[last] - ids[new]), strict=True)))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by short, long: those whose short name is in two documents or more, with the first document of the long name, and whether the short name has others."""

    def settle(c: list[np.ndarray]) -> pa.RecordBatch:
        short, long, block, low, more = c
        high = low + more
        new = np.r_[True, short[1:] != short[:-1]]
        at = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        several = np.minimum.reduceat(low, at) != np.maximum.reduceat(high, at)
        new_long = new | np.r_[True, long[1:] != long[:-1]]
        at_long = np.flatnonzero(new_long)
        first = np.minimum.reduceat(low, at_long)[np.cumsum(new_long) - 1]
        varied = (np.add.reduceat(new_long.astype(np.int64), at) > 1)[of]
        keep = several[of] & (varied | (high > first))
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (block, short, long, first, varied)], names=["block", "short", "long", "first", "varied"])

    return _by_name(batches, 5, settle)


MARKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int32()), ("name", pa.int64()), ("at", pa.int32()), ("spans", pa.binary())])


def _known(texts: pa.Table, found: pa.Table) -> Iterator[tuple]:
    """The parts of a block's texts, each once, with their positions that are found: (part, names, positions, text, first and last start, settled, open)."""
    short, long, first, varied = (found.column(k).to_numpy() for k in ("short", "long", "first", "varied"))
    pair = _mixed(short.view(np.uint64)) + long.view(np.uint64)
    order = np.argsort(pair)
    pair, first, varied = pair[order], first[order], varied[order]
    rows = {(i, d): t for i, d, t in zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), texts.column("text").to_pylist(), strict=True)}
    for part in chunks([(key[0], k, rows[key].encode()) for k, key in enumerate(sorted(rows))]):
        names, positions, of, begin, last, one, two = ranked(part)
        own = _mixed(one) + two
        at = np.minimum(np.searchsorted(pair, own), len(pair) - 1)
        hit = pair[at] == own
        positions, of, begin, last, at = positions[hit], of[hit], begin[hit], last[hit], at[hit]
        done = np.array([r[0] for r in part], np.int64)[of] > first[at]
        yield part, names, positions, of, begin, last, done, ~done & varied[at]


def _halves(names: Names, positions: np.ndarray, begin: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both middle names of positions, 0 where no 50-byte string needs it."""
    right = np.where(last >= positions - REST, names.at(MIDDLE, positions), np.uint64(0))
    return right, np.where(begin < positions - REST, names.at(MIDDLE, positions - REST), np.uint64(0))


def _block_halves(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Per block: the middle names of open positions, with the first document of each and how much larger the last one is."""
    one, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if texts.num_rows and found.num_rows:
        for part, names, positions, of, begin, last, _, still in _known(texts, found):
            own = np.array([r[0] for r in part], np.int64)[of[still]]
            for half in _halves(names, positions[still], begin[still], last[still]):
                one.append(half[half != 0])
                ids.append(own[half != 0])
    one, ids = np.concatenate(one), np.concatenate(ids)
    order = np.lexsort((ids, one))
    one, ids = one[order], ids[order]
    new = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][: len(one)])
    last = np.r_[new[1:], len(one)] - 1 if len(one) else new
    block = np.full(len(new), texts.column("block")[0].as_py() if texts.num_rows else 0, np.int64)
    return pa.table({"short": one[new].view(np.int64), "block": block, "low": ids[new], "more": ids[last] - ids[new]})


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (short, block, low, more) sorted by name: those whose name is in two documents or more."""

    def settle(c: list[np.ndarray]) -> pa.RecordBatch:
        short, block, low, more = c
        at = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
        several = np.minimum.reduceat(low, at) != np.maximum.reduceat(low + more, at)
        keep = np.repeat(several, np.diff(np.r_[at, len(short)]))
        return pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(short[keep])], names=["block", "short"])

    return _by_name(batches, 4, settle)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (name, doc_id, block, row, at) sorted by name: those in a later document than the name's first."""

    def settle(c: list[np.ndarray]) -> pa.RecordBatch:
        name, doc, block, row, at = c
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        keep = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(name)]))
        return pa.RecordBatch.from_arrays([pa.array(block[keep]), pa.array(row[keep]), pa.array(at[keep])], names=["block", "row", "at"])

    return _by_name(batches, 5, settle)


def _by_name(batches: Iterator[pa.RecordBatch], columns: int, settle) -> Iterator[pa.RecordBatch]:
    """settle(columns) for runs of rows that hold all rows of each value in the first, sorted column. Parts of a run are put together once, when it ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]
        if not len(own[0]):
            continue
        last = held[-1][0][-1] if held else own[0][0]
        starts = np.flatnonzero(np.r_[own[0][0] != last, own[0][1:] != own[0][:-1]])
        if not len(starts):
            held.append(own)
            continue
        cut_at = int(starts[-1])
        done = [np.concatenate(x) for x in zip(*held, [x[:cut_at] for x in own], strict=True)] if held else [x[:cut_at] for x in own]
        if len(done[0]):
            yield settle(done)
        held = [[x[cut_at:] for x in own]]
    if held:
        yield settle([np.concatenate(x) for x in zip(*held, strict=True)])


def _block_marks(texts: pa.Table, told: pa.Table) -> pa.Table:
    """Per block: one row for each text with the spans that the longer rank settles, and a row for each 50-byte string that it and the middle ones leave open.

    A text is named by its number among the block's, in order of id and digest. Of a string that several documents of the block hold
    the first one's are left open alone: the others' come after that one, whatever other blocks hold, so that a string which is
    everywhere gives each block one document's rows.
    """
    out: dict[str, list] = {k: [] for k in MARKS.names}
    found = told.filter(pc.is_valid(told.column("long")))
    if not texts.num_rows or not found.num_rows:
        return pa.table({f.name: pa.array([], f.type) for f in MARKS})
    middle = np.unique(told.filter(pc.is_null(told.column("long"))).column("short").to_numpy()).view(np.uint64)
    middle = np.sort(np.r_[middle, np.uint64(0)])
    repeated = lambda x: (x != 0) & (middle[np.minimum(np.searchsorted(middle, x), len(middle) - 1)] == x)
    block = texts.column("block")[0].as_py()
    parts = {k: [] for k in MARKS.names}
    for part, names, positions, of, begin, last, done, still in _known(texts, found):
        for k in np.unique(of[done]).tolist():
            mine = done & (of == k)
            spans = np.stack([begin[mine] - names.begin[k], last[mine] + LENGTH - names.begin[k]], 1)
            out["doc_id"].append(part[k][0])
            out["row"].append(part[k][1])
            out["spans"].append(spans.astype("<i4").tobytes())
        if still.any():
            positions, of, begin, last = positions[still], of[still], begin[still], last[still]
            right, left = map(repeated, _halves(names, positions, begin, last))
            edge = positions - REST
            begin, last, of = np.r_[np.maximum(begin, edge)[right], begin[left]], np.r_[last[right], np.minimum(last, edge - 1)[left]], np.r_[of[right], of[left]]
            n = np.maximum(0, last - begin + 1)
            starts = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n)[: n.sum()] + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            of_start = np.repeat(of, n)
            parts["name"].append(names.at(LENGTH, starts).view(np.int64))
            parts["at"].append((starts - names.begin[of_start]).astype(np.int32))
            parts["doc_id"].append(np.array([r[0] for r in part], np.int64)[of_start])
            parts["row"].append(np.array([r[1] for r in part], np.int32)[of_start])
    ids, rows, open_names, starts_at = (np.concatenate(parts[k]) if parts["name"] else np.zeros(0, np.int64) for k in ("doc_id", "row", "name", "at"))
    if len(ids):
        order = np.lexsort((ids, open_names))
        begins = np.flatnonzero(np.r_[True, open_names[order][1:] != open_names[order][:-1]])
        least = np.empty(len(ids), ids.dtype)
        least[order] = np.repeat(ids[order][begins], np.diff(np.r_[begins, len(ids)]))
        later = ids > least
        mine = np.flatnonzero(later)
        mine = mine[np.argsort(rows[mine], kind="stable")]
        edges = np.flatnonzero(np.r_[True, rows[mine][1:] != rows[mine][:-1]]) if len(mine) else np.zeros(0, np.int64)
        for own in np.split(mine, edges[1:]) if len(mine) else ():
            at = np.sort(starts_at[own])
            gap = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + LENGTH])
            out["doc_id"].append(int(ids[own[0]]))
            out["row"].append(int(rows[own[0]]))
            out["spans"].append(np.stack([at[gap], at[np.r_[gap[1:], len(at)] - 1] + LENGTH], 1).astype("<i4").tobytes())
        ids, rows, open_names, starts_at = (x[~later] for x in (ids, rows, open_names, starts_at))
    n = len(out["doc_id"])
    settled = pa.table([pa.array([block] * n, pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["row"], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(out["spans"], pa.binary())], schema=MARKS)
    if not len(ids):
        return settled
    left_open = pa.table([pa.array(np.full(len(ids), block)), pa.array(ids), pa.array(rows), pa.array(open_names), pa.array(starts_at), pa.nulls(len(ids), pa.binary())], schema=MARKS)
    return pa.concat_tables([settled, left_open])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def remove(text: bytes, spans: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left) for spans [start, end), which may overlap or touch."""
    if not len(spans):
        return 0, 0, text
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > end[:-1]])
    begin, end = spans[new, 0].tolist(), end[np.r_[new[1:], len(spans)] - 1].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
    return len(text) - len(kept), len(begin), kept


#: In place of a start: the text is a copy of an earlier one, and goes as a whole.
WHOLE = -1


def _block_results(texts: pa.Table, marks: pa.Table, keep_text: bool = False) -> pa.Table:
    given = list(zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), strict=True))
    keys = sorted(set(given))
    spans: dict[tuple, list] = {}
    for i, d, row, at, packed in zip(*(marks.column(k).to_pylist() for k in ("doc_id", "digest", "row", "at", "spans")), strict=True):
        own = np.frombuffer(packed, "<i4").reshape(-1, 2) if at is None else np.array([[at, at + LENGTH]], np.int32)
        spans.setdefault((i, d) if row is None else keys[row], []).append(own if at != WHOLE else None)
    out: list[list] = [[] for _ in RESULT]
    for i, d, t in zip(texts.column("doc_id").to_pylist(), texts.column("digest").to_pylist(), texts.column("text").to_pylist(), strict=True):
        raw = t.encode()
        own = spans.get((i, d))
        if own and any(x is None for x in own):
            own = [np.array([[0, len(raw)]], np.int32)]
        removed, n, kept = remove(raw, np.concatenate(own) if own else np.zeros((0, 2), np.int32))
        for column, x in zip(out, (i, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None), strict=True):
            column.append(x)
    return pa.table([pa.array(c, f.type) for c, f in zip(out, RESULT, strict=True)], schema=RESULT)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text if that is asked for.

    Every byte covered by a 50-byte string that also starts in a row with a smaller doc_id is removed; what is left at a cut may
    be no whole character, which kept_text shows as a replacement character. Null texts count as empty. Rows with a null
    doc_id have no smaller or larger neighbours: they stay whole and take nothing from others. Rows of one id don't affect each
    other; repeated rows are judged each. An empty table gives no rows. Other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(whole()).cast("long"))).first()[0] or 0
    blocks = max(4, -(-size // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text")).withColumn("md5", F.md5("text")).withColumn("digest", F.xxhash64("md5"))
    block = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(blocks)).alias("block")
    named = rows.where("doc_id is not null")
    texts = named.select(block, "doc_id", "digest", "text")
    firsts = named.groupBy("md5").agg(F.min("doc_id").alias("doc_id")).withColumn("digest", F.xxhash64("md5")).select(block, "doc_id", "digest", "md5")

    def by_block(other: DataFrame):
        return texts.groupBy("block").cogroup(other.groupBy("block"))

    def results(t: pa.Table, m: pa.Table) -> pa.Table:
        return _block_results(t, m, keep_text)

    ranks = by_block(firsts.drop("md5")).applyInArrow(_block_ranks, "short long, long long, block long, low long, more long")
    found = stored(ranks.repartition("short").sortWithinPartitions("short", "long").mapInArrow(_neighbours, "block long, short long, long long, first long, varied boolean"))  # read twice
    del ranks
    release(docs.sparkSession)
    halves = by_block(found).applyInArrow(_block_halves, "short long, block long, low long, more long")
    middle = halves.repartition("short").sortWithinPartitions("short").mapInArrow(_several, "block long, short long")
    told = found.unionByName(middle, allowMissingColumns=True)
    marks = stored(by_block(told).applyInArrow(_block_marks, "block long, doc_id long, row int, name long, at int, spans binary"))  # read twice
    del halves, middle, told
    release(docs.sparkSession)
    still = marks.where("name is not null").select("name", "doc_id", "block", "row", "at")
    open_ = still.repartition("name").sortWithinPartitions("name", "doc_id").mapInArrow(_later, "block long, row int, at int")
    copies = named.where(F.octet_length("text") >= LENGTH).select(block, "doc_id", "digest", "md5").join(firsts.select("md5", F.col("doc_id").alias("first")), "md5").where(F.col("doc_id") > F.col("first"))
    copies = copies.select("block", "doc_id", "digest", F.lit(WHOLE).alias("at"), F.lit(None).cast("binary").alias("spans"))
    settled = marks.where("name is null").select("block", "row", "spans")
    done = by_block(settled.unionByName(open_, True).unionByName(copies, True)).applyInArrow(results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    zero = F.lit(0).cast("long")
    rest = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), (F.col("text") if keep_text else F.lit(None).cast("string")).alias("kept_text"))
    out = done.unionByName(rest)
    return out if keep_text else out.drop("kept_text")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
