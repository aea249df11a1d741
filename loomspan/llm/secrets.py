"""Secret scans: fixed patterns, and strings near sensitive words that a primed compressor can't shorten."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

KINDS = ("assign", "access", "hex", "novel")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words that make what follows sensitive, and identifiers that code is full of, which prime the compressor.
SENSITIVE = re.compile(r"(?:secret|passw|passphrase|pwd|token|credential|api.?key|private.?key|access.?key|client.?key|auth|bearer|signing|encryption.?key)", re.I | re.A)
STEMS = ("secret", "passw", "passphrase", "pwd", "token", "credential", "key", "auth", "bearer", "signing")
IDENTIFIERS = """
import return class function const static public private protected void string number boolean null true false undefined
self this super init main args kwargs value values key keys name names type types index length size count result results
response request header headers body status code error errors message data payload config configuration settings options
option default defaults enabled disabled user username users account email address password passwd secret token tokens
access_key api_key client_id client_secret private_key public_key authorization bearer basic session cookie login logout
host hostname server port protocol http https url uri path file filename directory folder root base database connection
connect query select insert update delete from where table column row rows schema index primary foreign key constraint
env environment production staging development test testing debug info warning exception raise throw catch try finally
version build release package module library dependency requirements install deploy container image service cluster node
example placeholder changeme your_token_here YOUR_API_KEY xxxxxxxxxxxxxxxx 0123456789abcdef abcdefghijklmnopqrstuvwxyz
0000000000000000 1234567890123456 ABCDEFGHIJKLMNOPQRSTUVWXYZ getValue setValue toString fromString createUser updateUser
""".split()

#: Prose and code that every compression begins with: by it the compressor knows how often letters, digits and marks occur in plain text,
#: whatever the length of the surroundings.
PLAIN = """The service reads its settings once when it starts and keeps them until it stops. Each request is checked, then passed to a worker, which writes the
result and the time that it took. Quite often a job fails because a file is missing, a key has expired or the network is slow; the queue then tries it again
after a minute or two, five times at most. def load(path, size=1024): for line in open(path): if not line.strip(): continue; name, value = line.split("=", 1);
found[name] = int(value) if value.isdigit() else value; return found. SELECT id, name, count(*) FROM users WHERE created > '2023-05-17' GROUP BY id, name
ORDER BY 2 DESC LIMIT 100; private static final int MAX_SIZE = 65536; if (x == null || y.isEmpty()) { throw new IllegalStateException("value of " + key); }
"""
#: Characters of surroundings that are compressed along, how near before a candidate a sensitive word must be, its least length, and the
#: least marginal bytes for each of its characters. Where letters and digits are mixed, as in no word of a language, a share of what
#: CONTROLS random strings of lower-case letters and digits cost at the same place is enough: of all such strings these cost least.
AROUND, NEAR, SHORTEST, NOVEL, NOVEL_MIXED, CONTROLS = 400, 48, 16, 0.8, 0.86, 6
#: What may follow a candidate: compressed sizes are whole bytes, and several endings round differently.
ENDINGS = (b"", b"e", b"the of", b"0 = x;", b" and")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
MIXED = re.compile(r"[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]")


@cache
def _compressor():
    import zstandard

    primed = zstandard.ZstdCompressionDict("\n".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


@cache
def _controls(n: int) -> list[bytes]:
    """Random strings of n characters, the same in every process."""
    rng = random.Random(n)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)).encode() for _ in range(CONTROLS)]


def novelties(text: str, start: int, end: int, others: list[bytes]) -> list[float]:
    """Bytes that the candidate, and then each of the others in its place, adds to its compressed surroundings, for each of its own; the means over several endings."""
    around = "".join([PLAIN, text[end : end + AROUND // 4], text[max(0, start - AROUND) : start]]).encode()
    size = lambda own: sum(len(_compressor().compress(around + own + e)) for e in ENDINGS)
    bare = size(b"")
    return [(size(own) - bare) / len(ENDINGS) / len(own) for own in (text[start:end].encode(), *others)]


def is_novel(text: str, start: int, end: int) -> bool:
    mixed = MIXED.search(text, start, end)
    own, *others = novelties(text, start, end, _controls(min(end - start, 4 * SHORTEST)) if mixed else [])
    return own >= (min(NOVEL, NOVEL_MIXED * sum(others) / CONTROLS) if mixed else NOVEL)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every base match; runs of hexadecimal digits are maximal, as the pattern is greedy."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS) or not text.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def novel_spans(text: str, sure: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates near a sensitive word that the compressor can't shorten and no sure span overlaps."""
    found, known, starts, ends = [], set(), [], []  # the runs of a candidate's characters are looked at from left to right
    taken = sorted((s, e) for s, _, e in sure)
    upto = list(accumulate((e for _, e in taken), max))  # the furthest end of the spans that begin no later
    low = text.lower()
    if not any(w in low for w in STEMS):
        return []
    for m in SENSITIVE.finditer(text):
        for c in CANDIDATE.finditer(text, m.end(), min(len(text), m.end() + NEAR + 200)):
            a, b = c.span()
            if a - m.end() > NEAR:
                break
            if a in known:
                continue
            known.add(a)
            k = bisect_right(starts, a) - 1
            if k < 0 or a >= ends[k]:
                k += 1
                starts.insert(k, a)
                ends.insert(k, CANDIDATE.match(text, a).end())
            b = ends[k]
            k = bisect_left(taken, (b,)) - 1
            if (k < 0 or upto[k] <= a) and is_novel(text, a, b):
                found.append((a, 3, b))
    out, end = [], 0
    for a, k, b in sorted(found):  # of those that begin within one run the first
        if a >= end:
            out.append((a, k, b))
            end = b
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])


def find_secrets(docs: DataFrame) -> DataFrame:
    """The secrets in every row of docs (doc_id, text).

    n_<kind> and base_sha256 are of the base patterns' matches; spans has these and the novel ones, by start, then kind; n_novel
    counts the latter: runs of SHORTEST characters or more that begin within NEAR characters after a sensitive word, of which the
    first wins where several begin in one run. Null texts count as empty; long texts are read whole; repeated rows are found each; an empty table
    gives no rows. Other columns are ignored.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in SCHEMA]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                novel = novel_spans(text, base)
                kinds = [k for _, k, _ in base]
                row = [i, *(kinds.count(k) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel), len(novel)]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)

    texts = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    return texts.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
