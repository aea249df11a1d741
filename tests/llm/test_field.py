import itertools
import random

import numpy as np

from loomspan.llm import pii


def brute(length, segments, scores):
    """The sum over all sets of segments that don't overlap, and the share of it that each segment has."""
    total, own = 0.0, np.zeros(len(segments))
    for n in range(len(segments) + 1):
        for chosen in itertools.combinations(range(len(segments)), n):
            covered = [t for k in chosen for t in range(*segments[k])]
            if len(covered) == len(set(covered)):
                weight = np.exp(sum(scores[k] for k in chosen))
                total += weight
                own[list(chosen)] += weight
    return np.log(total), own / total


def test_marginals_equal_brute_force():
    rng = random.Random(1)
    for _ in range(30):
        length = rng.randint(1, 7)
        segments = [(i, rng.randint(i + 1, length)) for i in (rng.randrange(length) for _ in range(rng.randint(0, 8)))]
        scores = [rng.uniform(-2, 2) for _ in segments]
        log_sum, p = pii.marginals(length, segments, scores)
        want_sum, want = brute(length, segments, scores)
        assert abs(log_sum - want_sum) < 1e-9 and np.allclose(p, want)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    field = pii.Likelihood([pii._example(rng) for _ in range(12)], 0.1)
    w = rng.normal(size=len(field.names)) * 0.3
    value, gradient = field.at(w)
    for k in rng.choice(len(w), 10, replace=False):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert abs((field.at(w + step)[0] - field.at(w - step)[0]) / 2e-5 - gradient[k]) < 1e-4


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(7)
    field = pii.Likelihood([pii._example(rng) for _ in range(200)], 0.1)
    weights = pii.trained(200)
    w = np.array([weights[n] for n in field.names])
    start, end = field.at(np.zeros(len(w)))[0], field.at(w)[0]
    assert end > 0.15 * start and np.abs(field.at(w)[1]).max() < 3


def held_out(rng):
    """Sentences of forms that the training generator doesn't make, with their spans as (kind, text)."""
    word = lambda: rng.choice(["harbour", "signal", "orchard", "lantern", "copper", "meadow", "granite", "willow"])
    num = lambda n: "".join(str(rng.randint(1, 9)) for _ in range(n))
    address = rng.choice(["{0} {{at}} {1} {{dot}} edu", "{0} <at> {1} <dot> io", "{0}_{1} at {2} dot co dot uk", "{0} (at) {1} (dot) {2} (dot) org", "{0} -at- {1} -dot- net"]).format(word(), word(), word())
    phone = rng.choice(["+{0} {1}/{2}", "({1}) {2} {3}", "{1} {2} {3}", "{1}/{2}-{3}"]).format(num(2), num(3), num(3) + num(1), num(4))
    card = num(15)
    card += next(str(c) for c in range(10) if pii.luhn(card + str(c)))
    card = rng.choice(["_", "*", " / ", " . "]).join(card[k : k + 4] for k in range(0, 16, 4))
    ip = rng.choice([" [.] ", " (.) ", "(.)"]).join(str(rng.randint(1, 255)) for _ in range(4))
    kind, text = rng.choice([("email", address), ("phone", phone), ("card", card), ("ip", ip), (None, f"the {word()} at {word()} of {num(4)}"), (None, f"{num(2)} {word()} dot {word()}")])
    lead = {"phone": ["tel", "call us on"], "card": ["card", "visa"], "ip": ["host", "server"], "email": ["write to", "contact"]}.get(kind, ["see"])
    return f"{word()} {word()} , {rng.choice(lead)} {text} , {word()} {word()}", kind, text


def test_forms_that_the_generator_lacks():
    """Recall and precision by overlap; README states what comes out."""
    rng, weights = random.Random(3), pii.trained()
    there = found = clean = wrong = 0
    for _ in range(600):
        text, kind, own = held_out(rng)
        at = text.index(own)
        base = pii.base_spans(text)
        spans = [(a, pii.KINDS[k], b) for a, k, b in base] + [(a, pii.KINDS[k], b) for a, k, b in pii.field_spans(text, weights, [(a, b) for a, _, b in base])]
        hit = any(k == kind and a < at + len(own) and b > at for a, k, b in spans)
        there, found = there + (kind is not None), found + (kind is not None and hit)
        clean, wrong = clean + (kind is None), wrong + (kind is None and bool(spans))
    print(f"held-out forms: recall {found / there:.3f}, clean sentences marked {wrong / clean:.3f}")
    assert found / there > 0.6 and wrong / clean < 0.1
