import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspan.llm import resampling

from .helpers import docs, empty, odd


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(rows, target, percent=5):
    own = {i: features(t) for i, t in rows}
    s, t = Counter(b for _, f in own.values() for b in f), Counter(b for x in target for b in features(x)[1])
    n, m = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = {}
    for i, (_, f) in own.items():
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in own if own[i][0] >= 20), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(able[: percent * len(able) // 100]):
        out[i][3] = k + 1
    return out


def told(df):
    return {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in df.collect()}


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    words = ["Alpha", "beta", "GAMMA", "naïve", "𝒳y", "x1", "don't", "ÉCOLE", "z"]
    say = lambda: " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(rng.randint(5, 60)))
    return [(k, say()) for k in range(700)], [say() for _ in range(20)]


def test_equals_the_formula(spark, made):
    rows, target = made
    d, b = docs(spark, [t for _, t in rows]).repartition(7), spark.createDataFrame([(t,) for t in target], "text string")
    assert told(resampling.resample(d, b)) == expected(rows, target)
    assert told(resampling.resample(d, b, percent=60)) == expected(rows, target, 60)


def test_few_fences_and_small_blocks_change_nothing(spark, made, monkeypatch):
    """Bounds that are guessed from few rows, ranges that outnumber them, blocks of three rows."""
    rows, target = made
    for name, n in (("FENCES", 60), ("LEAST", 3), ("BLOCK", 3)):
        monkeypatch.setattr(resampling, name, n)
    d, b = docs(spark, [t for _, t in rows]).repartition(9), spark.createDataFrame([(t,) for t in target], "text string")
    assert told(resampling.resample(d, b, percent=30)) == expected(rows, target, 30)


def test_a_third_of_all_rows_are_one(spark, monkeypatch):
    """One row repeats: ranks are 1, 2, 3 on, and higher scores come first."""
    monkeypatch.setattr(resampling, "LEAST", 10)
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text)] * 200 + [(k + 100, f"{text} {k}") for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = resampling.resample(d, spark.createDataFrame([(text,)], "text string"), percent=50).collect()
    drawn = sorted((r["rank"], r.score, r.doc_id) for r in got if r["rank"])
    assert len(got) == 600 and [r[0] for r in drawn] == list(range(1, 301))
    assert [r[1:] for r in drawn] == sorted(((r.score, r.doc_id) for r in got), key=lambda x: (-x[0], x[1]))[:300]


def test_ties_go_to_the_smaller_id_and_null_comes_last(spark, monkeypatch):
    monkeypatch.setattr(resampling, "weighed", lambda d, *_: d.select("doc_id", F.lit(20).cast("long").alias("n_words"), *(F.lit(1).cast("long").alias(c) for c in ("n_features", "weight", "score"))))
    rows = [(k,) for k in (5, None, 3, 2**63 - 1, -4, 9)]
    d = spark.createDataFrame(rows, "doc_id long").repartition(3)
    got = resampling.resample(d, None, percent=100).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [-4, 3, 5, 9, 2**63 - 1, None]


def test_odd_rows(spark):
    b = spark.createDataFrame([("x y z",), (None,)], "text string")
    got = resampling.resample(odd(spark), b, percent=50)
    n = odd(spark).count()
    assert got.count() == n and got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert all(r.weight == 0 and r["rank"] is None for r in got.where("n_features = 0").collect())
    assert resampling.resample(empty(spark), b).count() == 0
    assert resampling.resample(odd(spark), b.limit(0)).count() == n


def test_tournament_is_a_sort():
    rng = random.Random(2)
    for _ in range(50):
        runs, blocks = rng.randint(1, 20), []
        for run in range(runs):
            own = sorted(((-rng.randint(0, 30), rng.randint(0, 50)) for _ in range(rng.randint(0, 40))))
            for j, at in enumerate(range(0, len(own), 4)):
                part = own[at : at + 4]
                blocks.append({"run": run, "block": j, "ids": [d for _, d in part], "scores": [-s for s, _ in part]})
        blocks.sort(key=lambda b: (-b["scores"][0], b["ids"][0], b["run"], b["block"]))
        total = sum(len(b["ids"]) for b in blocks)
        wanted = rng.randint(0, total + 3)
        out = list(resampling.merged(iter(blocks), wanted))
        rows = [(-b["scores"][at], b["ids"][at]) for b, at, came in out if came is not None]
        everything = sorted((-s, d) for b in blocks for s, d in zip(b["scores"], b["ids"], strict=True))
        assert rows == everything[:wanted] and len(out) == total
        assert sorted((-b["scores"][at], b["ids"][at]) for b, at, _ in out) == everything
