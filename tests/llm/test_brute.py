"""Operators against plain versions of the same definition, on small tables."""

import random
from collections import Counter

import numpy as np

from loomspan.llm import decontaminate, language


def plain_grams(text):
    """Trigrams of letters and blanks whose middle is a letter."""
    flat = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return [flat[k : k + 3] for k in range(len(flat) - 2) if flat[k + 1].isalpha()]


def test_language_scores_equal_plain_sets():
    """The filter's scores, corrected for false positives, against shares of exact sets."""
    rng = random.Random(4)
    alphabets = {"a": "abcdeé", "b": "defghß", "c": "ghijkłm"}
    say = lambda k, n: " ".join("".join(rng.choice(alphabets[k]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    held = {k: say(k, 300) for k in alphabets}
    sets = {k: set(plain_grams(t)) for k, t in held.items()}
    model = language.Filter.of({k: np.unique(language.ngrams([t])[0]) for k, t in held.items()})
    texts = [say(rng.choice("abc"), rng.randint(1, 30)) + say(rng.choice("abc"), rng.randint(0, 9)) for _ in range(300)]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        grams = plain_grams(text)
        share = {k: sum(g in own for g in grams) / max(1, len(grams)) for k, own in sets.items()}
        total = sum(share.values())
        assert abs(score - (max(share.values()) / total if total else 0)) < 0.02
        assert share[name] >= max(share.values()) - 0.02


def test_learnt_ngrams_equal_a_plain_count(spark):
    """Nothing is chosen away below the sample; n-grams of the least share are held."""
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(20)), rng.choice("xy")) for i in range(60)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sizes = Counter(r[2] for r in rows)
    assert model.langs == sorted(sizes, key=lambda k: (-sizes[k], k))
    counts = {k: Counter(g for _, t, x in rows if x == k for g in plain_grams(t)) for k in sizes}
    want = language.Filter.of({k: np.unique(np.concatenate([language.ngrams([t])[0] for _, t, x in rows if x == k])) for k in model.langs})
    least = {k: min(c.values()) / sum(c.values()) for k, c in counts.items()}
    assert all(x >= language.LEAST for x in least.values()) and (model.masks == want.masks).all()


def plain_search(items, text):
    """Every window of the grid, each compared with each item of its width by the common subsequence alone."""
    codes, _ = decontaminate.words([text])
    cell, n = decontaminate.CELL, len(codes)
    found = {}
    for width, own in items.widths.items():
        step, held, last = max(1, width // (decontaminate.STRIDE * cell)), -(-width // cell), -(-n // cell)
        for start in sorted({*range(0, max(0, last - held), step), max(0, last - held)}):
            start, end = start * cell, min((start + held) * cell, n)
            region = codes[max(0, start - width // 4) : min(n, end + width // 4)]
            for i, code in zip(own.ids, own.codes, strict=True):
                if (share := decontaminate.leaked(code, region)) > found.get(i, 0):
                    found[i] = share
    return found


def test_search_equals_comparing_all_windows(monkeypatch):
    """Where every window is a candidate, the counts of shared words cut nothing that the common subsequence accepts; stretches join."""
    monkeypatch.setattr(decontaminate, "NEAR", -2.0)
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(k, " ".join(say(rng.randint(5, 40)))) for k in range(40)]
    items = decontaminate.Items.of(rows, np.random.default_rng(1).normal(size=(decontaminate.FEATURES, 4)).astype(np.float32))
    hits = 0
    for _ in range(60):
        body = say(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(rows)[1].split()
            words = [w for w in words if rng.random() > 0.2]
            for _ in range(rng.randint(0, len(words) // 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(vocabulary))
            at = rng.randint(0, len(body))
            body[at:at] = words
        text = " ".join(body).encode()
        got = {i: share for i, share, _ in decontaminate.search(items, [text])[0]}
        want = plain_search(items, text)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        hits += len(got)
    assert hits > 20


def test_cosines_find_what_comparing_all_windows_finds(spark):
    """Of what the common subsequence accepts somewhere, the candidates by cosine hold 98 of 100 or more, and all that is verbatim."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    space, texts = decontaminate.decompose(docs), [r.text for r in docs.select("text").orderBy("doc_id").collect() if len(r.text) > 600]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").orderBy("item_id").collect()]
    items, rng = decontaminate.Items.of(rows, space), random.Random(8)
    there = got = 0
    for share in (0.0, 0.1, 0.2, 0.35):
        for i, text in rows:
            body, item = rng.choice(texts).split()[:150], text.split()
            last = len(item) - decontaminate.answer_size(len(item))
            for k in rng.sample(range(last), min(last, int(share * len(item)))):
                item[k] = rng.choice(body)
            at = rng.randint(0, len(body))
            planted = " ".join(body[:at] + item + body[at:]).encode()
            found = {x for x, *_ in decontaminate.search(items, [planted])[0]}
            codes, (want, _) = next((o.codes[o.ids.index(i)] for o in items.widths.values() if i in o.ids)), decontaminate.words([planted])
            accepted = any(decontaminate.leaked(codes, want[p : p + len(codes)]) > 0 for p in range(len(want) - len(codes) + 1))
            there, got = there + accepted, got + (accepted and i in found)
            assert share or i in found
    assert there > 3 * len(rows) and got >= 0.98 * there
