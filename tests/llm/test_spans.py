import hashlib
import random
import re

import numpy as np

from loomspan.llm import language, pii, secrets, tokens

from .helpers import docs, empty, odd


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_pii_base_equals_brute_force():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@+- 9(") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(text)) == brute_pii(text), text
    card = "pay 4111 1111-1111 1111 now, 10.0.0.255 or 10.0.0.256 at x@y.zz"
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans(card)] == ["email", "ip", "card"]


def test_field_is_accurate_on_unseen_sentences():
    weights, rng, right, found, there = pii.trained(), np.random.default_rng(99), 0, 0, 0
    for _ in range(200):
        words, spans = pii._example(rng)
        got = set(pii.decode(words, weights))
        right, found, there = right + len(got & set(spans)), found + len(got), there + len(spans)
    assert right / found > 0.9 and right / there > 0.9


def test_field_decides_like_all_segmentations():
    """The dynamic program finds the best of all segmentations of short sentences."""
    weights, rng = pii.trained(), np.random.default_rng(5)
    for _ in range(20):
        words = pii._example(rng)[0][:9]
        options = [(i, j, label, sum(weights.get(f, 0.0) for f in fs)) for i, j, label, fs in pii._candidates(words)]

        def best(at, words=words, options=options):
            if at == len(words):
                return 0.0
            return max([best(at + 1), *(s + best(j) for i, j, _, s in options if i == at)])

        score = {(i, j, x): s for i, j, x, s in options}
        assert abs(sum(score[s] for s in pii.decode(words, weights)) - best(0)) < 1e-9


def test_pii_table(spark):
    texts = ["mail bob at example dot com today", "ip 1.2.3.4", None, ""]
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, texts)).collect()}
    assert got[0].n_email == 0 and got[0].spans.startswith("email:") and got[0].n_added == 1
    assert got[1].base_sha256 == hashlib.sha256(b"ip:3:10").hexdigest() and got[1].spans == "ip:3:10"
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(odd(spark)).count() == odd(spark).count() and pii.find_pii(empty(spark)).count() == 0


def brute_secrets(text):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c + "?" * (c == "_") for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secret_base_equals_brute_force():
    rng = random.Random(2)
    parts = ["Password", "TOKEN", "apikey", "api_KEY", ":", "=", '"', " ", "abcdef012345", "Zz9/", "AKIA", "QWERTYUIOP12345678", "0a1b2c3d4e5f6071", "ſecret", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert sorted(secrets.base_spans(text)) == brute_secrets(text), text


def test_novel_secrets(spark):
    texts = ["my bearer is dGhpcyBpcyBhIHNlY3JldA9x7Zq3 ok", "the secret ingredient is internationalisation yes", None]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, texts)).collect()}
    assert got[0].spans == "novel:13:41" and got[0].n_novel == 1
    assert got[1].spans == "" and got[2].spans == ""
    assert secrets.find_secrets(odd(spark)).count() == odd(spark).count() and secrets.find_secrets(empty(spark)).count() == 0


def test_token_counts_equal_the_tokenizer(spark):
    texts = ["a <|endoftext|> b<|endoftext|>", "", None, "  \n\n x y　z 12³ ① ''", "don't WE'LL\t\t end  ", "𝒳🦊 ß naïve " * 300, "same words same words " * 50]
    texts += [f"word{i} " * (i % 7) + "common text here" for i in range(200)]
    tok = tokens._tokenizer(tokens.tokenizer_path())[0]
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False)) and got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 1024)
    assert tokens.count_tokens(odd(spark)).count() == odd(spark).count() and tokens.count_tokens(empty(spark)).count() == 0


def test_filter_returns_all_languages_of_an_ngram():
    grams = {k: np.unique(language.ngrams([t])[0]) for k, t in {"a": "the cat the hat", "b": "le chat the rat"}.items()}
    f = language.Filter.of(grams)
    assert f.langs == ["a", "b"]
    for k, lang in enumerate(f.langs):
        for j in range(language.LOOKUPS):
            assert (f.masks[language.slots(grams[lang], j), 0] >> np.uint64(k) & np.uint64(1)).all()
    assert f.predict(["the hat", None, "123 !?", "le chat"])[0] == ["a", "und", "und", "b"]


def test_language_held_out_accuracy(spark):
    rng = random.Random(6)
    parts = {"x": ["ba", "lo", "mi", "ta"], "y": ["sch", "ung", "ein", "zu"], "z": ["ção", "que", "los", "ar"]}
    langs = [rng.choice("xyz") for _ in range(300)]
    texts = [" ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 4))) for _ in range(30)) for k in langs]
    out = language.identify(docs(spark, texts, lang=langs)).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.lang_pred == langs[r.doc_id] and 0 <= r.score <= 1 for r in held)
    assert language.identify(odd(spark)).count() == odd(spark).count()
    assert language.identify(empty(spark)).count() == 0
    unlabelled = language.identify(docs(spark, ["abc"], lang=[None])).collect()
    assert unlabelled[0].lang_pred == "und"
