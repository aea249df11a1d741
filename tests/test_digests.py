"""Hashes of pairs against hashlib."""

import hashlib
import random

from loomspan.functions import digests


def test_first_digits_are_those_of_md5(monkeypatch):
    monkeypatch.setattr(digests, "LANES", 64)
    rng = random.Random(1)
    text = lambda n: bytes(rng.randrange(256) for _ in range(n))
    left, right = [text(n) for n in (0, 1, 3, 3, 4, 17, 20, 40, 54, 55, 56, 130)], [text(n) for n in (0, 1, 1, 2, 5, 15, 15, 38, 70)] + [b"%d" % k for k in range(150)]
    got = digests.first_digits(left, right)
    assert got.tolist() == [[int(hashlib.md5(a + b).hexdigest()[:8], 16) for b in right] for a in left]
    assert digests.first_digits([], [b"a"]).shape == (0, 1) and digests.first_digits([b"a"], []).shape == (1, 0)
