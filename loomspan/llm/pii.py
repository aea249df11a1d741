"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans that they miss.

The field works on the tokens of a window around digits and address marks. It scores whole candidate segments, of LONGEST
tokens at most, by features of the span as a whole (its digits, groups, separators, checksum, context), and a dynamic program
chooses boundaries and types together. It is trained here by its conditional likelihood, with the sum over all segmentations
by forward and backward passes, on sentences that a fixed generator makes.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

KINDS = ("email", "ip", "card", "phone")

# The base patterns. An address has one @, so its local part is the run of characters before it.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base match, by kind, leftmost and without overlap within a kind."""
    found, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = m.start()
            while at > end and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                found.append((at, 0, m.end()))
                end = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return found


# --- the field ---

LONGEST, REACH = 14, 3
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
DIGIT = re.compile(r"[0-9]")
LABELS = (None, *KINDS)
# Words that announce a kind.
CUES = {
    "email": {"email", "mail", "e", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "addr", "client"},
    "card": {"card", "visa", "credit", "pan", "payment", "mastercard"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "telephone"},
}
AT, DOT = {"at"}, {"dot"}


def segment_features(tokens: list[str], i: int, j: int, label: str) -> list[str]:
    """Features of the segment of tokens i to j as a label: they see the whole of it and the words before it."""
    seg = tokens[i:j]
    digits = "".join(t for t in seg if t[0].isdigit() and t.isascii())
    groups = [t for t in seg if t.isascii() and t.isdigit()]
    words = [t.lower() for t in seg if t.isalpha()]
    marks = [t for t in seg if not t.isalnum()]
    before = {t.lower() for t in tokens[max(0, i - REACH) : i]}
    n = len(digits)
    at = "@" in marks or bool(AT & set(words)) and i < j
    dot = "." in marks or bool(DOT & set(words))
    out = [
        "bias", f"digits{0 if not n else 1 if n < 7 else 2 if n < 10 else 3 if n < 14 else 4 if n < 17 else 5 if n < 20 else 6}",
        f"groups{min(len(groups), 6)}", f"words{min(len(words), 3)}", f"length{min(j - i, 8)}", f"at{at}", f"dot{dot}",
        "ends" + ("d" if seg[-1][0].isdigit() else "w" if seg[-1].isalpha() else "m"), "starts" + ("d" if seg[0][0].isdigit() else "w" if seg[0].isalpha() else seg[0]),
    ]
    if 14 <= n <= 19 and not words:
        out.append(f"luhn{luhn(digits)}")
    if len(groups) == 4 and not words:
        out.append(f"octets{all(len(g) < 4 and int(g) < 256 for g in groups)}:{''.join(sorted(set(marks)))[:3]}")
    if marks:
        out.append(f"only{''.join(sorted(set(marks)))[:4]}" if not words else f"some{len(set(marks))}")
    if at and dot and words:
        k = next(x for x, t in enumerate(seg) if t == "@" or t.lower() in AT)
        out.append(f"around{0 < k < len(seg) - 1}{any(t == '.' or t.lower() in DOT for t in seg[k:])}")
        out.append(f"glued{sum(a.isalnum() and b.isalnum() and a.lower() not in AT | DOT and b.lower() not in AT | DOT for a, b in zip(seg, seg[1:], strict=False)) > 0}")
    if any(cue & before for name, cue in CUES.items() if name == label):
        out.append("cue")
    follows = j < len(tokens) and (tokens[j][0].isdigit() or tokens[j] in "@-")
    out.append(f"goes{follows}")
    return [f"{label}|{f}" for f in out]


def _candidates(tokens: list[str]) -> list[tuple[int, int, str, list[str]]]:
    """The segments that could be something: they begin and end at a word, a number, + or (, and hold digits or an at and a dot."""
    out = []
    for i in range(len(tokens)):
        if not (tokens[i].isalnum() or tokens[i] in "+("):
            continue
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            seg = tokens[i:j]
            if not seg[-1].isalnum():
                continue
            low = {t.lower() for t in seg}
            n = sum(len(t) for t in seg if t.isascii() and t.isdigit())
            no_word = not any(t.isalpha() for t in seg)
            labels = (["email"] if ("@" in low and ("." in low or low & DOT) or low & AT and low & DOT) and not no_word else []) + (["ip"] if no_word and 4 <= n <= 12 and len(seg) >= 7 and {t for t in seg if not t.isalnum()} <= {".", "[", "]"} else []) + (["card"] if no_word and 14 <= n <= 19 else []) + (["phone"] if no_word and 7 <= n <= 15 else [])
            out += [(i, j, x, segment_features(tokens, i, j, x)) for x in labels]
    return out


def decode(tokens: list[str], weights: dict[str, float], candidates=None) -> list[tuple[int, int, str]]:
    """The segmentation of highest score: a token alone scores 0 as nothing, a segment the sum of its features' weights."""
    by_end: dict[int, list] = {}
    for i, j, label, fs in _candidates(tokens) if candidates is None else candidates:
        by_end.setdefault(j, []).append((i, label, sum(weights.get(f, 0.0) for f in fs)))
    best, back = [0.0], [None]
    for j in range(1, len(tokens) + 1):
        score, step = best[-1], None
        for i, label, s in by_end.get(j, ()):
            if best[i] + s > score:
                score, step = best[i] + s, (i, label)
        best.append(score)
        back.append(step)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return out[::-1]


def _example(rng: np.random.Generator) -> tuple[list[str], list[tuple[int, int, str]]]:
    """A made-up sentence with its spans: plain and disguised data, and numbers that are none."""
    syllables = ["ka", "lo", "mi", "ter", "van", "su", "red", "on", "pel", "ti"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        d = "4" + num(14)
        return d + next(str(c) for c in range(10) if luhn(d + str(c)))

    def piece() -> tuple[str, str | None]:
        k = rng.integers(0, 14)
        if k == 0:
            return f"{word()}.{word()} @ {word()}.com", "email"
        if k in (1, 2):
            a, d = [("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)"), ("AT", "DOT")][rng.integers(0, 4)]
            return f"{word()} {a} {word()} {d} {rng.choice(['com', 'org', 'net'])}", "email"
        if k == 3:
            return ".".join(map(str, rng.integers(0, 256, 4))), "ip"
        if k == 4:
            s = [" . ", "[.]"][rng.integers(0, 2)]
            return s.join(map(str, rng.integers(0, 256, 4))), "ip"
        if k in (5, 6):
            c = card()
            s = [".", "/", "-", " "][rng.integers(0, 4)]
            return s.join(c[x : x + 4] for x in range(0, 16, 4)), "card"
        if k in (7, 8):
            return [f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(2)} {num(3)} {num(4)} {num(3)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"][rng.integers(0, 5)], "phone"
        return [num(int(rng.integers(1, 20))), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}.{num(1)}", f"{word()} at {word()} .", f"{num(2)} at {num(2)}", f"{num(5)}-{num(5)}-{num(7)}", num(16), f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{word()} at {' '.join(word() for _ in range(rng.integers(2, 6)))} dot {word()}"][rng.integers(0, 9)], None

    tokens, spans = [], []
    for _ in range(rng.integers(1, 4)):
        tokens += TOKEN.findall(" ".join(word() for _ in range(rng.integers(1, 4))))
        text, label = piece()
        if label and rng.random() < 0.5 or label in ("phone", "card") and rng.random() < 0.3:
            tokens += [str(rng.choice(sorted(CUES[label]))), ":"]
        own = TOKEN.findall(text)
        i = len(tokens)
        tokens += own
        if label:
            spans.append((i, i + len(own), label))
        if rng.random() < 0.5:
            tokens.append(str(rng.choice([".", ",", ";"])))
    return tokens + TOKEN.findall(word()), spans


def marginals(length: int, segments: list[tuple[int, int]], scores: list[float]) -> tuple[float, list[float]]:
    """The logarithm of the sum over all segmentations of so many tokens, and the probability of each segment; tokens outside score 0.

    Forward and backward sums over positions: a segmentation is a sequence of candidate segments and single tokens.
    """
    by_end: list[list[int]] = [[] for _ in range(length + 1)]
    by_start: list[list[int]] = [[] for _ in range(length + 1)]
    for k, (i, j) in enumerate(segments):
        by_end[j].append(k)
        by_start[i].append(k)

    def add(terms: list[float]) -> float:
        high = max(terms)
        return high + math.log(sum(math.exp(t - high) for t in terms))

    ahead, behind = [0.0] * (length + 1), [0.0] * (length + 1)
    for j in range(1, length + 1):
        own = by_end[j]
        ahead[j] = add([ahead[j - 1], *(ahead[segments[k][0]] + scores[k] for k in own)]) if own else ahead[j - 1]
    for i in range(length - 1, -1, -1):
        own = by_start[i]
        behind[i] = add([behind[i + 1], *(behind[segments[k][1]] + scores[k] for k in own)]) if own else behind[i + 1]
    return ahead[length], [math.exp(ahead[i] + s + behind[j] - ahead[length]) for (i, j), s in zip(segments, scores, strict=True)]


class Likelihood:
    """The penalised conditional log-likelihood of sentences (tokens, spans) and its gradient."""

    def __init__(self, data: list[tuple[list[str], list[tuple[int, int, str]]]], penalty: float):
        self.penalty, self.sentences, self.gold = penalty, [], []
        names: dict[str, int] = {}
        features, widths = [], []
        for tokens, spans in data:
            found = _candidates(tokens)
            self.sentences.append((len(tokens), [(i, j) for i, j, *_ in found]))
            self.gold += [(i, j, x) in spans for i, j, x, _ in found]
            for *_, own in found:
                features += [names.setdefault(f, len(names)) for f in own]
                widths.append(len(own))
        self.names, self.features, self.of = list(names), np.array(features), np.repeat(np.arange(len(widths)), widths)
        self.gold = np.array(self.gold, float)

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        scores = np.bincount(self.of, weights=w[self.features], minlength=len(self.gold))
        total, shares, k = float(scores @ self.gold), [], 0
        for length, segments in self.sentences:
            own, k = scores[k : k + len(segments)].tolist(), k + len(segments)
            log_sum, p = marginals(length, segments, own)
            total -= log_sum
            shares += p
        gradient = np.bincount(self.features, weights=(self.gold - np.array(shares))[self.of], minlength=len(w))
        return total - self.penalty / 2 * float(w @ w), gradient - self.penalty * w


@cache
def trained(examples: int = 700, steps: int = 30, penalty: float = 0.1, seed: int = 7) -> dict[str, float]:
    """The weights of greatest penalised conditional likelihood of so many sentences of the generator, by steps with a rate of its own for each weight; the same in each run."""
    rng = np.random.default_rng(seed)
    field = Likelihood([_example(rng) for _ in range(examples)], penalty)
    w = np.zeros(len(field.names))
    rate, before = np.full(len(w), 0.2), np.zeros(len(w))
    for _ in range(steps):
        gradient = field.at(w)[1]
        same = np.sign(gradient) * np.sign(before)
        rate = np.clip(rate * np.where(same > 0, 1.2, np.where(same < 0, 0.5, 1.0)), 1e-4, 1.0)
        before = np.where(same < 0, 0.0, gradient)
        w = w + np.sign(before) * rate
    return dict(zip(field.names, w.tolist(), strict=True))


def is_mark(token: str) -> bool:
    """Every candidate segment holds a mark: digits, @, at or dot."""
    return "0" <= token[0] <= "9" or token == "@" or token.lower() in AT | DOT


def windows(tokens: list[str], taken: Callable[[int, int], bool] = lambda i, j: False) -> list[tuple[int, int]]:
    """The runs of tokens that the field reads: all that a segment with a mark can reach and what its features see, joined where they overlap.

    Marks further apart than a segment is long are in no segment together. Groups of marks are left out that can't make a
    candidate: too few digits, no @, not both words, or taken.
    """
    groups: list[list[int]] = []
    for k in (k for k, t in enumerate(tokens) if is_mark(t)):
        if groups and k - groups[-1][-1] < LONGEST:
            groups[-1].append(k)
        else:
            groups.append([k])
    out: list[list[int]] = []
    for own in groups:
        low = {tokens[k].lower() for k in own}
        if sum(len(tokens[k]) for k in own if tokens[k].isdigit()) < 4 and "@" not in low and not (low & AT and low & DOT) or taken(own[0], own[-1]):
            continue
        i, j = max(0, own[0] - LONGEST + 1 - REACH), min(len(tokens), own[-1] + LONGEST + 1)
        if out and i <= out[-1][1]:
            out[-1][1] = j
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def field_spans(text: str, weights: dict[str, float], sure: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """What the field finds besides the spans that are sure already."""
    low = text.lower()
    if "@" not in text and not ("at" in low and "dot" in low) and len(DIGIT.findall(text)) < 4:
        return []
    found = []
    sure = sorted(sure)
    starts = [a for a, _ in sure]
    spots = [m.span() for m in TOKEN.finditer(text)]
    tokens = [text[x:y] for x, y in spots]

    def taken(i: int, j: int) -> bool:
        a, b = spots[i][0], spots[j][1]
        k = bisect_right(starts, a)
        return any(s <= a and e >= b for s, e in sure[max(0, k - 4) : k])

    for first, last in windows(tokens, taken):
        for i, j, label in decode(tokens[first:last], weights):
            x, y = spots[first + i][0], spots[first + j - 1][1]
            if not any(s < y and x < e for s, e in sure):
                found.append((x, KINDS.index(label), y))
    out, end = [], 0
    for x, k, y in sorted(set(found)):
        if x >= end:
            out.append((x, k, y))
            end = y
    return out


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find_pii(docs: DataFrame, examples: int = 700) -> DataFrame:
    """The personal data in every row of docs (doc_id, text).

    n_<kind> and base_sha256 are of the base patterns' matches; spans has these and what the field adds, by start, then kind;
    n_added counts the latter. Null texts count as empty; long texts are read whole; repeated rows are found each; an empty
    table gives no rows. Other columns are ignored.
    """
    weights = trained(examples)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in SCHEMA]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                added = field_spans(text, weights, [(a, b) for a, _, b in base])
                kinds = [k for _, k, _ in base]
                row = [i, *(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)

    texts = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    return texts.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
