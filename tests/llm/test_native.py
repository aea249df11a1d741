import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import mixing, quality, sharding

from .helpers import docs, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    texts = ["", None, "a b c a b c", "x x x x x", "a b\nb a\na b\n \n\t\n", "# * a|b <c>\x0b\x0c d", "𝒳 y 𝒳 y 𝒳 y", "one"]
    got = {r.doc_id: tuple(r)[1:] for r in quality.counts(docs(spark, texts)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_quality_rejects_what_is_unlike_its_group(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    clean = [" ".join(word() for _ in range(int(rng.integers(80, 200)))) for _ in range(150)]
    junk = [" ".join(word() + "%%%" for _ in range(100)) for _ in range(5)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, clean + junk)).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(150, 155))
    assert not got[150].base_failed


def test_estimates_are_as_good_as_those_of_many_random_starts(spark):
    """Distances against a plain search of the subset of least determinant."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    texts = [" ".join(word(int(rng.integers(3, 8))) + "%" * int(rng.random() < 0.05) for _ in range(int(rng.integers(60, 300)))) for _ in range(240)]
    texts += [" ".join(word(2) + "|" for _ in range(int(rng.integers(60, 90)))) for _ in range(30)]
    rows = quality.features(quality.counts(docs(spark, texts))).select("doc_id", *quality.NAMES).orderBy("doc_id").collect()
    x, floor = np.array([r[1:] for r in rows]), np.square(list(quality.FEATURES.values()))
    best = (np.inf, None)
    for _ in range(60):
        own = rng.choice(len(x), 20, replace=False)
        for _ in range(30):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + np.diag(floor)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = np.argsort(d)[: int(0.75 * len(x))]
        best = min(best, (np.linalg.slogdet(np.cov(x[own].T, bias=True) + np.diag(floor))[1], d), key=lambda b: b[0])
    d = best[1] / max(1.0, np.median(best[1]) / quality.MEDIAN)
    got = np.array([r.distance for r in sorted(quality.judge(docs(spark, texts)).collect(), key=lambda r: r.doc_id)])
    assert np.corrcoef(np.log1p(d), np.log1p(got))[0, 1] > 0.99
    clear = np.abs(np.log(np.maximum(d, 1e-9) / quality.CUTOFF)) > 0.15
    assert ((d <= quality.CUTOFF) == (got <= quality.CUTOFF))[clear].all() and (got[240:] > quality.CUTOFF).all()


def test_quality_takes_odd_and_empty_tables(spark):
    out = quality.judge(odd(spark)).collect()
    assert len(out) == odd(spark).count() and all(not r.kept for r in out if r.base_failed)
    assert quality.judge(empty(spark)).count() == 0
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns


def test_targets_share_all_and_stop_at_the_cap(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, None: 100, "z": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    assert [r.source for r in sorted(got.values(), key=lambda r: r.source_rank)] == ["a", "b", "c", "z", None]
    assert {k: r.weight for k, r in got.items()} == {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    total = sum(sizes.values())
    assert sum(r.target for r in got.values()) == pytest.approx(total)
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in got.values())
    level = {k: r.target / r.weight for k, r in got.items() if r.target < 3 * r.source_size - 1e-6}
    assert max(level.values()) == pytest.approx(min(level.values()))


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(8).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(["w"] * int(rng.integers(1, 400))) for _ in range(300)]
    d = docs(spark, texts, source=[("s%d" % (i % 4)) if i % 3 else "hot" for i in range(300)])
    out = mixing.mix(d).collect()
    assert len(out) == 300 and all(0 <= r.taken <= 3 * r["size"] for r in out)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.02)
    assert sorted(map(tuple, mixing.mix(d.repartition(7)).collect())) == sorted(map(tuple, out))
    words = mixing.repeat_rows(d).select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words == pytest.approx(sum(r.target for r in {r.source: r for r in out}.values()), rel=0.1)


def test_mix_equals_brute_force(spark):
    """The schedule slot by slot, and the words of each source laid out one by one."""
    rng = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(rng.integers(0, 90))) for _ in range(120)]
    sources = [["a", "b", None][int(rng.integers(0, 9)) // 4] for _ in texts]
    d = docs(spark, texts, source=sources)
    out = {r.doc_id: r for r in mixing.mix(d, block_words=16).collect()}
    h = {r.doc_id: r.h for r in d.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", "source").alias("h")).collect()}
    size = {i: len(t.split()) for i, t in enumerate(texts)}
    names = sorted({s for s in sources if s}) + [None]
    total = {s: sum(size[i] for i in size if sources[i] == s) for s in names}
    target = {r.source: r.target for r in out.values()}
    n_blocks = {s: max(1, int(total[s] / 16 + 0.5)) for s in names}
    draws = [target[s] * n_blocks[s] / total[s] for s in names]
    times, rank = Counter(), Counter()
    ends = np.cumsum(draws) / sum(draws)
    for k in range(round(sum(draws))):
        point = sum((k >> b & 1) / 2 ** (b + 1) for b in range(40))
        s = names[min(int(np.searchsorted(ends, point, "right")), len(names) - 1)]
        if rank[s] < 3 * n_blocks[s]:
            times[s, rank[s] % n_blocks[s]] += 1
        rank[s] += 1
    for s in names:
        stream = [i for i in sorted(size, key=lambda i: (h[i] % 16, h[i], i)) if sources[i] == s for _ in range(size[i])]
        least, longer = divmod(total[s], n_blocks[s])
        taken = Counter()
        for b in range(n_blocks[s]):
            start = b * least + min(b, longer)
            for i in stream[start : start + least + (b < longer)]:
                taken[i] += times[s, b]
        assert {i: out[i].taken for i in size if sources[i] == s} == {i: taken[i] for i in size if sources[i] == s}


def test_mix_takes_odd_and_empty_tables(spark):
    out = mixing.mix(odd(spark)).collect()
    assert len(out) == odd(spark).count()
    assert all(r.taken == 0 for r in out if r["size"] == 0)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repeat_rows(odd(spark)).columns == odd(spark).columns


def test_shards_are_near_equal_and_places_gapless(spark):
    rng = np.random.default_rng(4)
    d = docs(spark, ["x" * int(rng.integers(0, 300)) for _ in range(2000)])
    out = sharding.shard(d).collect()
    assert len(out) == 2000 and {r.law for r in out} == {"bytes"}
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())
    for s in range(24):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_slot_maps_are_edited_not_made_anew(spark, tmp_path):
    loads = np.random.default_rng(5).integers(1, 100, 512)
    first = sharding.SlotMap.balanced(loads, 8)
    grown = first.grown(loads)
    moved = [(a, b) for a, b in zip(first.shard_of, grown.shard_of, strict=True) if a != b]
    assert grown.version == 2 and moved and all(b == 8 for _, b in moved)
    skew = loads.copy()
    skew[[k for k, s in enumerate(first.shard_of) if s == 0]] *= 3
    again = first.rebalanced(skew)
    before = np.bincount(first.shard_of, weights=skew).max()
    assert np.bincount(again.shard_of, weights=skew).max() < before
    assert sum(a != b for a, b in zip(first.shard_of, again.shard_of, strict=True)) < 120
    path = str(tmp_path / "maps")
    first.save(spark, path)
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == first


def test_a_stored_map_is_edited_by_the_query(spark, tmp_path):
    """The first run deals slots in turn and evens them; more rows of some slots make the next version, which moves few slots; one more shard takes its share."""
    path = str(tmp_path / "maps")
    rng = np.random.default_rng(7)
    first = docs(spark, ["x" * int(rng.integers(0, 200)) for _ in range(3000)])
    versions = [sharding.shard(first, 6, 256, path, 0.01).first().map_version, sharding.shard(first, 6, 256, path, 0.01).first().map_version]
    assert versions == [2, 2]
    before = sharding.SlotMap.load(spark, path)
    later = first.unionByName(docs(spark, ["y" * 900 for _ in range(200)]).withColumn("doc_id", F.col("doc_id") + 10_000))
    out = sharding.shard(later, 6, 256, path, 0.01).collect()
    after = sharding.SlotMap.load(spark, path)
    moved = sum(a != b for a, b in zip(before.shard_of, after.shard_of, strict=True))
    assert after.version == 3 and 0 < moved < 100 and all(after.shard_of[r.virtual_slot] == r.shard for r in out)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    more = sharding.shard(later, 7, 256, path, 0.05).collect()
    assert {r.shard for r in more} == set(range(7))


def test_shards_equal_brute_force(spark):
    """Places and shards by sorting all records in Python."""
    d = docs(spark, [f"text {k % 50}" * (k % 7) for k in range(500)])
    hashed = {r.doc_id: r for r in sharding.records(d, 64).collect()}
    out = {r.doc_id: r for r in sharding.shard(d, 5, 64).collect()}
    import zlib

    of = {}
    for i, r in enumerate(d.collect()):
        assert out[i].text_crc32 == zlib.crc32(r.text.encode()) and out[i]["size"] == len(r.text.encode()) + 8
        assert of.setdefault(hashed[i].virtual_slot, out[i].shard) == out[i].shard
    for s in range(5):
        own = sorted((i for i in out if out[i].shard == s), key=lambda i: (hashed[i].virtual_slot, hashed[i].part, i))
        assert [out[i].slot for i in own] == list(range(len(own)))


def test_shard_takes_odd_and_empty_tables(spark):
    out = sharding.shard(odd(spark)).collect()
    assert len(out) == odd(spark).count()
    assert all(r["size"] == 8 and r.text_crc32 == 0 for r in out if r.doc_id in (0, 1))
    assert sharding.shard(empty(spark)).count() == 0
