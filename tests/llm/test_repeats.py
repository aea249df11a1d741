import hashlib
import itertools
import random

import numpy as np

from loomspan.llm import decontaminate, neardup, suffixes
from loomspan.llm.shingles import shingles

from .helpers import docs, empty, odd


def brute_removal(rows):
    """(id, text) -> (bytes, removed, runs, digest), by a set of all 50-byte strings."""
    out, seen = [], set()
    for i, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        new = set()
        for _, text in group:
            b = (text or "").encode()
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                new.add(b[k : k + 50])
                if b[k : k + 50] in seen:
                    gone[k : k + 50] = b"\1" * 50
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
        seen |= new
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_removal_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "a" * 200, "b" + "a" * 120, "ab" * 100, "x" * 49, "x" * 49, "y" * 50, "y" * 50, None, ""]
    assert rows_of(suffixes.remove_repeats(docs(spark, texts))) == brute_removal(list(enumerate(texts)))


def test_removal_takes_odd_and_empty_tables(spark):
    named = [(r.doc_id, r.text) for r in odd(spark).collect() if r.doc_id is not None]
    got = suffixes.remove_repeats(odd(spark)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == brute_removal(named)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    kept = suffixes.remove_repeats(docs(spark, ["z" * 60, "z" * 60 + " more"]), keep_text=True).collect()
    assert {r.kept_text for r in kept} == {"z" * 60, " more"}


def test_samples_agree_as_often_as_weights_do():
    rng = random.Random(9)
    common = np.random.default_rng(9).integers(0, neardup.LEVELS + 1, neardup.COUNTERS).astype(np.uint8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    hits, true = [], []
    for k in range(40):
        other = list(base)
        for _ in range(k):
            other[rng.randrange(len(other))] = f"n{rng.random()}"
        a, b = shingles([" ".join(base), " ".join(other)])
        true.append(neardup.similarity(a, b, common))
        hits.append(np.mean(neardup.bands(a, common) == neardup.bands(b, common)))
    assert abs(np.mean(hits) - np.mean(np.array(true) ** neardup.ROWS)) < 0.06


def brute_groups(texts, common):
    own = shingles([t or "" for t in texts])
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or len(own[i][0]) and neardup.similarity(own[i], own[j], common) >= 0.8:
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    return of


def test_groups_equal_brute_force(spark):
    rng = random.Random(10)
    fresh = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for _ in range(25):
        base = fresh(rng.randint(60, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = f"m{rng.random()}"
            texts.append(" ".join(other))
    texts += ["short one", "short one", "", None, "other"]
    out = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [out[i].group_id for i in range(len(texts))] == brute_groups(texts, neardup.frequencies(docs(spark, texts)))
    assert all(r.kept == (r.doc_id == r.group_id) for r in out.values())


def test_groups_in_one_large_bucket(spark):
    """Near copies of one text, of which some are near it and others near nothing: found without meeting each other."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(f"u{rng.random()}" for _ in range(50)) for _ in range(300)]
    for k in range(60):
        other = list(base)
        for _ in range(k % 8):
            other[rng.randrange(len(other))] = f"m{rng.random()}"
        texts.append(" ".join(other))
    out = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    own = shingles(texts)
    common = neardup.frequencies(docs(spark, texts))
    of = {i: i for i in range(300, 360)}
    for i in range(300, 360):
        for j in range(300, i):
            if neardup.similarity(own[i], own[j], common) >= 0.8 and of[i] != of[j]:
                a, b = sorted((of[i], of[j]))
                of = {x: a if g == b else g for x, g in of.items()}
    assert {i: out[i] for i in of} == of and all(out[i] == i for i in range(300))


def test_texts_of_common_passages_equal_brute_force(spark):
    """Few passages in many texts: no shingle is rare."""
    rng = random.Random(12)
    pool = [" ".join(f"p{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(6)]
    texts = [" ".join([*rng.sample(pool, 3), *(f"u{rng.random()}" for _ in range(k % 9))]) for k in range(70)]
    out = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == brute_groups(texts, neardup.frequencies(docs(spark, texts)))


def test_chains_of_copies_equal_brute_force(spark):
    """Copies of copies, with changes that several of them share, and no text that is near all."""
    rng = random.Random(14)
    chain = [[f"w{k}" for k in range(120)]]
    for _ in range(120):
        other = list(rng.choice(chain[-30:]))
        for _ in range(rng.randint(1, 5)):
            other[rng.randrange(len(other))] = f"m{rng.random()}"
        chain.append(other)
    texts = [" ".join(x) for x in chain] + [" ".join(f"u{rng.random()}" for _ in range(80)) for _ in range(200)]
    out = {r.doc_id: r.group_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    want = brute_groups(texts, neardup.frequencies(docs(spark, texts)))
    assert len(set(want)) > 203 and [out[i] for i in range(len(texts))] == want


def test_frequencies_leave_out_what_all_counters_hold():
    counts = np.full(1000, 7)
    counts[:3] = 8, 57, 107
    levels = neardup.idf_levels(counts, 100)
    assert levels[0] == levels[5] == neardup.LEVELS and levels[2] == 0 and 0 < levels[1] < 4


def test_near_duplicates_take_odd_and_empty_tables(spark):
    out = neardup.near_duplicates(odd(spark)).collect()
    assert len(out) == odd(spark).count() and all(r.kept for r in out if r.doc_id is None)
    assert neardup.near_duplicates(empty(spark)).count() == 0
    kept = neardup.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_the_table():
    rng = np.random.default_rng(12)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 40))
        assert decontaminate.common_subsequence(a, b) == plain_subsequence(a.tolist(), b.tolist())


def test_decomposition_equals_that_of_the_whole_matrix(spark):
    """The space spanned against numpy's decomposition of the full TF-IDF matrix of the passages."""
    rng = random.Random(15)
    topics = [[f"t{k}w{j}" for j in range(12)] for k in range(8)]
    texts = [" ".join(rng.choice(topics[k % 8]) for _ in range(rng.randint(20, 90))) for k in range(200)]
    space = decontaminate.decompose(docs(spark, texts))
    passages = []
    for t in texts:
        f = decontaminate.feature(decontaminate.words([t.encode()])[0])
        passages += [np.bincount(f[k : k + decontaminate.PASSAGE], minlength=decontaminate.FEATURES) for k in range(0, len(f), decontaminate.PASSAGE)]
    counts = np.array(passages, float)
    idf = np.log((len(counts) + 1) / ((counts > 0).sum(0) + 1)) + 1
    basis = np.linalg.svd(counts * idf, full_matrices=False)[2][:8].T
    own = np.linalg.qr(space / idf[:, None])[0]
    # the eight topics' directions are found
    assert (np.linalg.norm(own.T @ basis, axis=0) ** 2).sum() > 8 - 0.1


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    items = [" ".join(f"i{k}w{j}" for j in range(10)) for k in range(20)]
    texts = ["before " + items[k] + " after" if k % 2 else f"plain text {k}" for k in range(20)] + [items[3] + " and " + items[4]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = {r.doc_id: r.items for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert out == {**{k: [k] if k % 2 else [] for k in range(20)}, 20: [3, 4]}
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs(spark, texts), bench).collect()) == list(range(0, 20, 2))


def test_leaks_are_found_and_others_left(spark):
    rng = random.Random(13)
    words = [f"word{k}" for k in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [say(rng.randint(12, 60)) for _ in range(30)]
    texts, true = [], []
    for k in range(150):
        body = say(rng.randint(50, 400))
        if k % 5 == 0:
            item = list(rng.choice(items))
            if k % 10 == 0:  # a paraphrase: some words go, others come in
                for _ in range(len(item) // 10):
                    item[rng.randrange(len(item) - 5)] = "other"
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() for w in item] if k % 15 == 0 else item
            true.append(k)
        texts.append(" ".join(body))
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (None, "no id here at all"), (99, None), (98, "too short")], "item_id long, text string")
    out = decontaminate.decontaminate(docs(spark, texts), bench).collect()
    assert sorted(r.doc_id for r in out if r.contaminated) == true
    clean = decontaminate.keep_clean(docs(spark, texts), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(150)) - set(true))
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd(spark), none).collect())
    assert decontaminate.decontaminate(odd(spark), bench).count() == odd(spark).count()
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.keep_clean(odd(spark), bench).count() == odd(spark).count()


def test_runs_of_a_name_are_put_together():
    """Whatever the batches, each name's rows come together, in order."""
    import pyarrow as pa

    def batches(names, size):
        table = pa.table({"name": np.array(names), "doc": np.arange(len(names))})
        return table.to_batches(max_chunksize=size)

    names = [1] * 7 + [2] + [3] * 12 + [4, 5, 5]
    for size in (1, 2, 3, 5, 100):
        told = []
        list(suffixes._by_name(iter(batches(names, size)), 2, lambda c: told.append([c[0].tolist(), c[1].tolist()])))
        assert sum((t[0] for t in told), []) == names and sum((t[1] for t in told), []) == list(range(len(names)))
        assert all(a[0][-1] != b[0][0] for a, b in zip(told, told[1:], strict=False))


def test_a_line_that_is_everywhere_leaves_a_block_one_document():
    """Of a string in many documents of a block the first document's rows are left open, and the others' are settled."""
    import pyarrow as pa

    rng = random.Random(6)
    line = "this licence line stands in every document of the whole corpus"
    texts = [f"{rng.random()} before {line} after {rng.random()}" for _ in range(60)]
    digests = list(range(60))
    block = pa.table({"block": pa.array([0] * 60, pa.int64()), "doc_id": pa.array(range(60), pa.int64()), "digest": pa.array(digests, pa.int64()), "text": texts})
    ranks = suffixes._block_ranks(block, pa.table({"block": pa.array([0] * 60, pa.int64()), "doc_id": pa.array(range(60), pa.int64()), "digest": pa.array(digests, pa.int64())}))
    order = ranks.sort_by([("short", "ascending"), ("long", "ascending")])
    found = pa.Table.from_batches(list(suffixes._neighbours(iter(order.combine_chunks().to_batches()))))
    halves = suffixes._block_halves(block, found).sort_by("short").combine_chunks()
    told = pa.concat_tables([found, *map(lambda b: pa.Table.from_batches([b]), suffixes._several(iter(halves.to_batches())))], promote_options="default")
    marks = suffixes._block_marks(block, told)
    open_ = marks.filter(pa.compute.is_valid(marks.column("name"))).to_pylist()
    names = {}
    for r in open_:
        names.setdefault(r["name"], set()).add(r["doc_id"])
    assert names and all(len(d) == 1 for d in names.values())
