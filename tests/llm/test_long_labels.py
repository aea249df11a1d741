import random

from loomspan.llm import pii


def test_addresses_with_long_domain_labels_are_found():
    weights = pii.trained()
    for label in ("uni", "universitylibrary", "universitylibraryofscience", "x" * 60):
        for at, dot in (("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]")):
            address = f"info {at} {label} {dot} org"
            text = f"write to {address} , please"
            assert [(text[a:b], k) for a, k, b in pii.field_spans(text, weights, [])] == [(address, 0)], text
    assert pii.field_spans("we meet at the library of the old town and dot every i", weights, []) == []


def test_windows_decide_like_the_whole_text():
    """No candidate is lost: in texts without sure spans the windows give what the field finds in all tokens at once."""
    weights, rng, some = pii.trained(), random.Random(8), 0
    parts = ["at", "dot", "@", ".", "word", "averyveryverylongword", "other", "text", "555", "0123", "+49", "-", "(", "mail", "org"]
    for _ in range(400):
        tokens = [rng.choice(parts if rng.random() < 0.4 else ["plain", "words", "here"]) for _ in range(rng.randint(0, 90))]
        text = " ".join(tokens)
        spots = [m.span() for m in pii.TOKEN.finditer(text)]
        whole = [(spots[i][0], pii.KINDS.index(x), spots[j - 1][1]) for i, j, x in pii.decode([text[a:b] for a, b in spots], weights)]
        assert pii.field_spans(text, weights, []) == whole, text
        some += len(whole)
    assert some > 100
