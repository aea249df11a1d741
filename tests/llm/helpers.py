import os
import random

#: Rows that every operator must take: nulls in any column, empty and blank texts, repeated rows, a long text, astral characters.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, block int, shard string, kept string, taken long"


def odd_rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(30_000))
    base = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(120))
    texts = [None, "", " \t\n ", "x", base, base, base + " tail", long, "𝒳 naïve ß ŒUVRE 🦊 " * 40, "a" * 5000, "line one\nline one\nline two\n" * 30]
    rows = [(i, t, "en" if i % 3 else None, ["s1", "s2", None][i % 3], None, "x", 1, "y", "z", 7) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[0], (None, base, "en", "s1", 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


SF = "/root/testdata/sf0.001"


def has_data():
    return os.path.exists(SF)
