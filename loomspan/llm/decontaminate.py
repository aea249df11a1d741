"""Benchmark decontamination by latent semantic retrieval.

A randomised singular value decomposition of the TF-IDF matrix of all passages is computed on the executors, in one scan: each
passage is added, with a random sign, to one of PROBES columns of a sketch, whose sums (features times PROBES, whatever the input)
come back; inverse document frequencies weigh its rows, and its RANK strongest left singular vectors are the space. All windows of
the documents, as wide as the items, are placed in that space; those of a cosine of NEAR or more with an item are its candidates.
Candidates are checked by the words that they share with the item, which limit the longest common subsequence, then by that
itself and the item's answer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

#: Hashed features, columns of the sketch, dimensions of the space, words of a passage that it is computed on.
FEATURES, PROBES, RANK, PASSAGE = 1 << 14, 192, 96, 32
#: Features of a row of partial sums, tasks whose sums meet first (as a power of two), and words counted at a time.
SLICE, TASKS, COUNTED = 1 << 8, 6, 1 << 21
#: The least cosine of a window and an item whose common subsequence is looked at.
NEAR = 0.25
#: Items of fewer words are searched for by exact match. So many items are compared in one scan of the documents: what executors
#: hold of them is bounded, about 3 KB for an item of 60 words.
SHORTEST, ITEMS = 5, 4000
#: The share of an item's words in the common subsequence that decides alone, and with the answer.
SAME, SAME_WITH_ANSWER = 0.75, 0.6
#: Each width of window is so many times the last; windows start at every (width / STRIDE)th word, in whole cells of CELL words.
WIDER, STRIDE, CELL = 1.2, 3, 4
#: Bytes of text, items, and cells of a text that are compared at a time; cells summed up at a time; numbers of a bit set.
CHUNK, BLOCK, STRETCH, TILE, SET = 1 << 18, 512, 1 << 12, 128, 8
_P = 0x9E3779B97F4A7C15 | 1

#: Bytes to bytes of lower case, and which bytes are part of words: ASCII letters and digits, and all beyond ASCII but what GAPS says.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: By first byte, the second bytes of Latin-1 characters that are no letters or numbers.
GAPS = {0xC2: np.setdiff1d(np.arange(0x80, 0xC0), [0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]), 0xC3: np.array([0x97, 0xB7])}
#: What is no part of a word in any script, and characters of scripts without blanks, with their marks: each is a word.
GAP_CHARS = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
ALONE = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}--\p{M}]\p{M}*+ー?+)", regex.V1)
_VALUES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def separated(text: bytes) -> bytes:
    """The text in lower case with composed characters, blanks for all gaps, and blanks around the characters that are words alone."""
    return ALONE.sub(r" \1 ", GAP_CHARS.sub(" ", unicodedata.normalize("NFC", text.decode()).lower())).encode()


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts as 64-bit numbers, and how many each text has; case is folded.

    Texts of ASCII and Latin-1 are taken by their bytes, others are separated before, by the same rules.
    """
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    if (raw > 0xC3).any():
        texts = [t if t.isascii() or max(t) <= 0xC3 else separated(t) for t in texts]
        raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    b = LOWER[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    up = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
    b[up] += 32
    inside = IN_WORD[b]
    for lead, seconds in GAPS.items():
        k = latin - 1 if lead == 0xC3 else np.flatnonzero(raw[:-1] == lead)
        k = k[np.isin(raw[k + 1], seconds)]
        inside[k] = inside[k + 1] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    n = 1 << (len(b) + 1).bit_length()
    p, q = _powers(n)
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * p[: len(b)], out=s[1:])
    codes = (s[end] - s[begin]) * q[begin]
    codes ^= codes >> np.uint64(32)
    codes *= np.uint64(0xC2B2AE3D27D4EB4F)
    codes ^= codes >> np.uint64(29)
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return codes, np.diff(np.searchsorted(begin, starts))


def feature(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(50)).astype(np.uint16)  # 14 bits


def parts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column in parts of CHUNK bytes about."""
    own, size = [], 0
    for t in column.to_pylist():
        own.append(t.encode())
        size += len(own[-1])
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


# --- decomposition ---

PARTIAL = "slice long, part long, n long, sums binary"


def _partial(slices: np.ndarray, part: int, n: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    counts = pa.array([n if k == 0 else 0 for k in slices.tolist()])
    return pa.RecordBatch.from_arrays([pa.array(slices), pa.array([part] * len(slices)), counts, pa.array([x.astype("<f4").tobytes() for x in sums], pa.binary())], names=["slice", "part", "n", "sums"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how often each feature is in each probe's passages, by their signs; in a last column, how many passages have it.

    Draws depend on the partition and the passage's place in it, so that a task that is run again draws the same.
    """
    task = TaskContext.get().partitionId()
    rng = np.random.default_rng([17, task])
    total, n = np.zeros((FEATURES, PROBES + 1), np.float32), 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def count() -> None:
        where, signs = (np.concatenate(x) for x in zip(*held, strict=True))
        total[:, :PROBES] += np.bincount(where, weights=signs, minlength=FEATURES * PROBES).reshape(FEATURES, PROBES)
        held.clear()

    for batch in batches:
        for texts in parts(batch.column(0)):
            codes, sizes = words(texts)
            if not len(codes):
                continue
            f, ends = feature(codes), np.cumsum(sizes)
            starts = np.concatenate([np.arange(e - s, e, PASSAGE) for e, s in zip(ends, sizes, strict=True)])
            drawn = rng.integers(0, 2 * PROBES, len(starts))
            passage = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(f)]))
            held.append((f.astype(np.int32) * PROBES + (drawn >> 1)[passage], (1.0 - 2.0 * (drawn & 1))[passage]))
            order = np.argsort(f, kind="stable")
            f, passage = f[order], passage[order]
            total[:, PROBES] += np.bincount(f[np.r_[True, (f[1:] != f[:-1]) | (passage[1:] != passage[:-1])]], minlength=FEATURES)
            n += len(starts)
            if sum(len(x) for x, _ in held) >= COUNTED:
                count()
    if held:
        count()
    for k in range(0, FEATURES if n else 0, SLICE):
        yield _partial(np.array([k]), task >> TASKS, n, [total[k : k + SLICE].ravel()])


def _sum(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n, at, part = np.zeros(SLICE * (PROBES + 1)), 0, 0, 0
    for batch in groups:
        for k in range(batch.num_rows):
            at, part, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), n + batch.column(2)[k].as_py()
            total += np.frombuffer(batch.column(3)[k].as_py(), "<f4")
    yield _partial(np.array([at]), part, n, [total])


def decompose(docs: DataFrame) -> np.ndarray:
    """For each feature, its inverse document frequency times its place in the space of singular vectors, each divided by its singular value.

    FEATURES / SLICE rows come to the driver. Directions that the passages don't have are zero.
    """
    partial = docs.select(whole().alias("text")).mapInArrow(_sketch, PARTIAL)
    sums, n = np.zeros((FEATURES, PROBES + 1)), 0
    for r in partial.groupBy("slice", "part").applyInArrow(_sum, PARTIAL).groupBy("slice").applyInArrow(_sum, PARTIAL).collect():
        sums[r["slice"] : r["slice"] + SLICE] = np.frombuffer(r["sums"], "<f4").reshape(SLICE, -1)
        n += r["n"]
    idf = np.log((n + 1) / (sums[:, PROBES] + 1)) + 1
    weighted = idf[:, None] * sums[:, :PROBES]
    squares, right = np.linalg.eigh(weighted.T @ weighted)
    squares, right = squares[::-1][:RANK], right[:, ::-1][:, :RANK]
    there = squares > 1e-9 * max(squares[0], 1e-12)
    # left vectors are weighted @ right / value; divided by the value once more, their coordinates have equal spread
    space = idf[:, None] * (weighted @ right) * np.where(there, squares[0] / np.where(there, squares, 1), 0)
    return np.ascontiguousarray((space / max(np.abs(space).max(), 1e-30)).astype(np.float32))


# --- search ---


def keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n words."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_P) + codes[k : k + len(out)]
    return out


def bits(codes: np.ndarray) -> np.ndarray:
    """For each word the set of it alone: one bit of SET numbers, a row for each of these."""
    out = np.zeros((SET, len(codes)), np.uint64)
    at = (codes >> np.uint64(20)).astype(np.int64) % (64 * SET)
    out[at >> 6, np.arange(len(codes))] = np.uint64(1) << (at & 63).astype(np.uint64)
    return out


@dataclass
class Width:
    """The items that a width of window is for: ids, word numbers, unit vectors, number of words, bit sets.

    places has, sorted, item times (known words + 1) plus known word for all words of all items; numbers, the word's number among
    its item's; times and answers, how often the item and its answer hold each of these.
    """

    ids: list[int]
    codes: list[np.ndarray]
    vectors: np.ndarray
    sizes: np.ndarray
    sets: np.ndarray
    places: np.ndarray
    numbers: np.ndarray
    times: np.ndarray
    answers: np.ndarray


@dataclass
class Items:
    """Benchmark items by width of window; known are the words of all of them, sorted. short has, by their number of words, the
    shorter ones: ids and keys, by key, and unit vectors."""

    space: np.ndarray
    known: np.ndarray
    widths: dict[int, Width]
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @cached_property
    def steps(self) -> np.ndarray:
        """The space in whole numbers, of which as many as a window has words can be summed; a last row is for no word."""
        scale = min(1 << 20, (1 << 30) // max(self.widths, default=1))
        return np.vstack([np.rint(self.space * scale), np.zeros((1, self.space.shape[1]))]).astype(np.int32)

    @classmethod
    def of(cls, rows: list[tuple[int, str]], space: np.ndarray) -> Items:
        by: dict[int, list] = {}
        brief: dict[int, list] = {}
        for i, text in rows:
            codes, _ = words([(text or "").encode()])
            if len(codes) >= SHORTEST:
                width = SHORTEST
                while width < len(codes):
                    width = int(np.ceil(width * WIDER))
                by.setdefault(width, []).append((i, codes))
            elif len(codes):
                v = space[feature(codes)].sum(0)
                brief.setdefault(len(codes), []).append((int(keys(codes, len(codes))[0]), i, v / max(np.linalg.norm(v), 1e-9)))
        known = np.unique(np.concatenate([c for found in by.values() for _, c in found] or [np.zeros(0, np.uint64)]))
        out = {}
        for width, found in sorted(by.items()):
            v = np.stack([space[feature(c)].sum(0) for _, c in found])
            sets = np.stack([np.bitwise_or.reduce(bits(c), axis=1) for _, c in found], axis=1)
            places, numbers = [], []
            times, answers = np.zeros((2, len(found), width + 1), np.int32)
            for k, (_, c) in enumerate(found):
                own, place = np.unique(c, return_inverse=True)
                rows_of = np.searchsorted(known, own)
                places.append(k * (len(known) + 1) + rows_of)
                numbers.append(np.arange(1, len(own) + 1))
                times[k] = np.bincount(place + 1, minlength=width + 1)
                answers[k] = np.bincount(place[-answer_size(len(c)) :] + 1, minlength=width + 1)
            out[width] = Width([i for i, _ in found], [c for _, c in found], v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), np.array([len(c) for _, c in found]), sets, np.concatenate(places), np.concatenate(numbers), times, answers)
        short = {}
        for n, found in brief.items():
            found.sort(key=lambda x: x[:2])
            short[n] = np.array([i for _, i, _ in found]), np.array([k for k, _, _ in found], np.uint64), np.stack([v for *_, v in found])
        return cls(space, known, out, short)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by one integer of bits that holds a row of the table."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def answer_size(n: int) -> int:
    """How many words the answer of an item of n words has: its last fifth."""
    return max(3, n // 5)


def leaked(item: np.ndarray, region: np.ndarray) -> float:
    """The share of the item's words in the common subsequence, negative if that is too little; the answer is the item's last fifth."""
    share = common_subsequence(item, region) / len(item)
    if share >= SAME:
        return share
    answer = item[-answer_size(len(item)) :]
    if share >= SAME_WITH_ANSWER and common_subsequence(answer, region) == len(answer):
        return share
    return -share


def search(items: Items, texts: list[bytes]) -> list[list[tuple[int, float, float]]]:
    """For each text the items in it: (item, share of the common subsequence, cosine).

    Windows of a cosine of NEAR or more with an item are candidates. The common subsequence is computed for every one of them that
    can pass: first the item's words that have no bit in the set of the window's words are counted, then each word as often as
    the item holds it, and those of the answer. These counts limit the common subsequence.
    """
    codes, sizes = words(texts)
    found: list[dict[int, tuple[float, float]]] = [{} for _ in texts]
    if not len(codes):
        return [[] for _ in texts]
    text_of = np.repeat(np.arange(len(texts)), sizes)
    for n, (ids, wanted, vectors) in items.short.items():
        if len(codes) < n:
            continue
        own = keys(codes, n)
        begin, end = np.searchsorted(wanted, own, "left"), np.searchsorted(wanted, own, "right")
        at = np.flatnonzero((begin < end) & (text_of[: len(own)] == text_of[n - 1 :]))
        _, once = np.unique(text_of[at] * len(wanted) + begin[at], return_index=True)
        for p in at[once].tolist():
            v = items.space[feature(codes[p : p + n])].sum(0)
            for x in range(begin[p], end[p]):
                found[text_of[p]][int(ids[x])] = 1.0, float(v @ vectors[x] / max(np.linalg.norm(v), 1e-9))
    if not items.widths:
        return [sorted((i, s, c) for i, (s, c) in f.items()) for f in found]
    at = np.minimum(np.searchsorted(items.known, codes), len(items.known) - 1)
    known = np.where(items.known[at] == codes, at, len(items.known))
    known = np.r_[known, len(items.known)]
    first = np.cumsum(sizes) - sizes
    # texts in cells: each begins one, and its last is filled up with words that are nowhere
    cells = -(-sizes // CELL)
    begin = np.cumsum(cells) - cells
    place = np.arange(len(codes)) + np.repeat(begin * CELL - first, sizes)
    of_cell = np.full(cells.sum() * CELL, FEATURES, np.int32)
    of_cell[place] = feature(codes)
    alone = np.zeros((SET, len(of_cell)), np.uint64)
    alone[:, place] = bits(codes)
    of_cell = of_cell.reshape(-1, CELL)
    held = np.bitwise_or.reduce(alone.reshape(SET, -1, CELL), axis=2)
    widest = max(items.widths)
    around = 2 * -(-widest // CELL)
    grid = {width: _grid(width, begin, cells) for width in items.widths}
    for low in range(0, len(of_cell), STRETCH):
        from_, to = max(0, low - around), min(len(of_cell), low + STRETCH + around)
        sums = _sums(items.steps, of_cell[from_:to])
        sets = [held[:, from_:to]]
        for width, own in items.widths.items():
            of, starts, ends, a, e = grid[width]
            here = slice(*np.searchsorted(starts, [low, low + STRETCH]))
            of, starts, ends, a, e = of[here], starts[here], ends[here], a[here], e[here]
            if not len(of):
                continue
            windows = (sums[ends - from_] - sums[starts - from_]).astype(np.float32)
            least = NEAR * np.sqrt(np.einsum("ij,ij->i", windows, windows))
            lacked = ~_united(sets, a - from_, e - from_)
            for block in range(0, len(own.ids), BLOCK):
                vectors = own.vectors[block : block + BLOCK]
                r, c = np.divmod(np.flatnonzero(windows @ vectors.T >= least[:, None]), len(vectors))
                c += block
                lacking = np.zeros(len(r), np.int32)
                for k in range(SET):
                    lacking += np.bitwise_count(own.sets[k][c] & lacked[k][r])
                able = np.flatnonzero(lacking <= ((1 - SAME_WITH_ANSWER) * own.sizes + 1e-9)[c])
                for k in range(0, len(able), 20_000):
                    w = r[able[k : k + 20_000]]
                    t = of[w]
                    start, end = (np.minimum(first[t] + (x[w] - begin[t]) * CELL, first[t] + sizes[t]) for x in (starts, ends))
                    a_, e_ = np.maximum(first[t], start - width // 4), np.minimum(first[t] + sizes[t], end + width // 4)
                    _check(items, width, codes, known, t, start, end, a_, e_, c[able[k : k + 20_000]], found)
    return [sorted((i, s, c) for i, (s, c) in f.items()) for f in found]


def _sums(steps: np.ndarray, of_cell: np.ndarray) -> np.ndarray:
    """The places of all cells up to each one, in whole numbers, whose differences are exact even where they overflow."""
    n = -(-len(of_cell) // TILE) * TILE
    out = np.zeros((n + 1, steps.shape[1]), np.int32)
    own = out[1 : len(of_cell) + 1]
    np.take(steps, of_cell[:, 0], axis=0, out=own)
    for k in range(1, CELL):
        own += steps[of_cell[:, k]]
    tiles = out[1:].reshape(-1, TILE, steps.shape[1])
    for tile in tiles:
        np.cumsum(tile, axis=0, out=tile)
    before = np.zeros(steps.shape[1], np.int32)
    for tile in tiles:
        tile += before
        before = tile[-1]
    return out


def _grid(width: int, begin: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """All windows of a width, in cells: their texts, starts and ends, and where what is around them starts and ends."""
    n, step, beside = -(-width // CELL), max(1, width // (STRIDE * CELL)), -(-(width // 4) // CELL)
    filled = np.flatnonzero(cells)
    over = np.maximum(0, cells[filled] - n)  # cells beyond the first window; the last one ends with its text
    several = -(-over // step) + 1
    of = np.repeat(filled, several)
    number = np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several)
    starts = begin[of] + np.minimum(number * step, np.repeat(over, several))
    last = begin[of] + cells[of]
    ends = np.minimum(starts + n, last)
    return of, starts, ends, np.maximum(begin[of], starts - beside), np.minimum(last, ends + beside)


def _united(sets: list[np.ndarray], a: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The union of the sets from a to e; sets[k] has those of 2^k cells from each place on, and grows as needed."""
    level = np.frexp(e - a)[1] - 1
    out = np.zeros((SET, len(a)), np.uint64)
    for k in np.unique(level).tolist():
        while len(sets) <= k:
            half = 1 << len(sets) - 1
            sets.append(sets[-1][:, :-half] | sets[-1][:, half:])
        own = np.flatnonzero(level == k)
        out[:, own] = sets[k][:, a[own]] | sets[k][:, e[own] - (1 << k)]
    return out


def _check(items: Items, width: int, codes: np.ndarray, known: np.ndarray, of, starts, ends, a, e, c, found: list[dict]) -> None:
    """Puts candidates (windows and items c of a width) that pass into found, each with its best share."""
    own = items.widths[width]
    spots = a[:, None] + np.arange(width + CELL + 2 * (width // 4))
    key = c[:, None] * len(items.known) + c[:, None] + known[np.where(spots < e[:, None], spots, len(codes))]
    near = np.minimum(np.searchsorted(own.places, key), len(own.places) - 1)
    place = np.where(own.places[near] == key, own.numbers[near], 0)
    there = np.bincount((np.arange(len(c))[:, None] * (width + 1) + place).ravel(), minlength=len(c) * (width + 1)).reshape(len(c), -1)
    shared = np.minimum(there, own.times[c]).sum(1)
    answered = (there >= own.answers[c])[:, 1:].all(1)
    for x in np.flatnonzero((shared >= SAME * own.sizes[c] - 1e-9) | (shared >= SAME_WITH_ANSWER * own.sizes[c] - 1e-9) & answered).tolist():
        hits, i = found[of[x]], own.ids[c[x]]
        if hits.get(i, (0.0,))[0] < 1.0:
            share = leaked(own.codes[c[x]], codes[a[x] : e[x]])
            if share > hits.get(i, (0.0,))[0]:
                v = items.space[feature(codes[starts[x] : ends[x]])].sum(0)
                hits[i] = share, float(v @ own.vectors[c[x]] / max(np.linalg.norm(v), 1e-9))


RESULT = "doc_id long, contaminated boolean, n_items long, items array<long>, share double, cosine double"


def searches(docs: DataFrame, benchmark: DataFrame) -> list:
    """The items that are searched for, ITEMS about in each broadcast, in the space of docs. The driver holds the items of one at a time."""
    space = decompose(docs)
    wanted = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    blocks = max(1, -(-wanted.count() // ITEMS))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartitionByRange(blocks, "block").sortWithinPartitions("block", "item_id", "text")
    of_block = groupby(dealt.toLocalIterator(), key=lambda r: r["block"])
    share = docs.sparkSession.sparkContext.broadcast
    return [share(Items.of([(r["item_id"], r["text"]) for r in rows], space)) for _, rows in of_block] or [share(Items.of([], space))]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, ascending), and share and cosine of the best one, for every row of docs (doc_id, text).

    An item (benchmark: item_id, text) is in a text if a passage near it holds SAME of its words in their order, or
    SAME_WITH_ANSWER of them and all of its last fifth; one of fewer than SHORTEST words, if all of them stand there in a row.
    Characters of scripts without blanks are words. Items without words or with a null id aren't searched for. Null
    texts count as empty: not contaminated. Ties of the best share go to the greater cosine. Repeated rows are judged each, but
    put together by id where there are more than ITEMS items; empty tables give no rows or no contamination. Long texts
    are read whole; other columns are ignored. All items go against all rows; passages whose cosine with the item is below NEAR
    aren't candidates.
    """
    rows, found = docs.select(F.col("doc_id").cast("long"), whole().alias("text")), None
    searched = searches(docs, benchmark)
    for shared in searched:

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[] for _ in range(5)]
                for texts in parts(batch.column(1)):
                    for hits in search(shared.value, texts):
                        best = max(hits, key=lambda x: x[1:], default=(0, None, None))
                        for column, x in zip(out, (bool(hits), len(hits), [h[0] for h in hits], best[1], best[2]), strict=True):
                            column.append(x)
                kinds = (pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "contaminated", "n_items", "items", "share", "cosine"])

        one = rows.mapInArrow(look, RESULT)
        found = one if found is None else found.unionByName(one)
    if len(searched) == 1:
        return found
    best = F.max(F.struct("share", "cosine"))
    joined = found.groupBy("doc_id").agg(F.max("contaminated").alias("contaminated"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("b"))
    return joined.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), "items", F.col("b")["share"].alias("share"), F.col("b")["cosine"].alias("cosine"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; in one scan, whatever the number of items."""
    for shared in searches(docs, benchmark):

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
                yield batch.filter(pa.array([not hits for part in parts(texts) for hits in search(shared.value, part)], pa.bool_()))

        docs = docs.mapInArrow(look, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
