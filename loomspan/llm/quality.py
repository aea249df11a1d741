"""Quality rules: counts of a text, and a minimum-covariance-determinant estimate per language and source that finds outlying counts.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, GAP, SMALL, cut, stored, table, whole

#: A text fails outright with fewer words, or if more than so many per cent of its words are in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Groups of language and source with fewer rows are estimated together; with fewer than FEW of these, none is an outlier, as a
#: covariance of five features means nothing there. Both are parameters of judge.
OWN, FEW = 100, 20
#: The share of a group that an estimate rests on; the most concentration steps, which end earlier once no determinant falls by
#: SETTLED of its logarithm; and the median of chi-squared with 5 degrees of freedom, for the consistency correction.
KEPT, STEPS, SETTLED, MEDIAN = 0.75, 12, 1e-2, 4.35146
#: The squared distance that rejects: the 0.9999993 quantile of chi-squared with 5 degrees of freedom. In the given tables nothing lies between it and 150.
CUTOFF = 36.5
#: The least standard deviation of each feature, in its own unit: what differs by less is no sign of low quality. Their squares
#: regularise every covariance, as most groups have features that hardly vary.
FEATURES = {"f_words": 0.5, "f_length": 0.08, "f_symbols": 0.25, "f_lines": 0.15, "f_repeats": 0.1}
NAMES = list(FEATURES)
GROUP = ["g_lang", "g_source"]
#: An estimate of a group by the start that it came from.
KEY = [*GROUP, "start"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Of an array of words: how many lie in 3-word windows that occur twice or more. Windows are told apart by 64-bit hashes; sorting puts equal ones together."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        twice = F.filter(pairs, lambda x, j: ((j > 0) & (x["h"] == pairs[F.greatest(j - 1, F.lit(0))]["h"])) | ((j < last) & (x["h"] == pairs[F.least(j + 1, last)]["h"])))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = lambda a: F.aggregate(
            a, F.struct(F.lit(-3).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda s, i: F.struct(i.alias("end"), (s["n"] + F.least(F.lit(3), i - s["end"])).alias("n")),
            lambda s: s["n"],
        )
        return let(at, gaps)

    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs(h), covered)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(found)


def _counted(df: DataFrame) -> DataFrame:
    """Adds the counts, base_failed and n_lines to rows with the column text."""
    text, shown = whole(), F.trim(whole(), F.lit(BLANKS))
    words = F.when(shown == "", F.array().cast("array<string>")).otherwise(F.split(shown, GAP))
    size = lambda c: F.char_length(c).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    df = df.withColumn("text", text).withColumn("words", words)
    df = df.select(
        *(c for c in df.columns if c not in ("text", "words")), F.size("words").cast("long").alias("n_words"), size(F.translate("text", BLANKS, "")).alias("word_chars"),
        (size("text") - size(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), _repeat_words).alias("n_repeat_words"),
        let(lines, F.size).alias("n_lines"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every whole text."""
    return _counted(docs.select("doc_id", "lang", "source", "text"))


def features(df: DataFrame) -> DataFrame:
    """The transformed counts: logarithms of the words, of their mean length and of the symbols per 100 words; the shares of repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.col(a).cast("double") / F.greatest(b, F.lit(1))
    return df.withColumns({
        "f_words": F.log1p(F.col("n_words").cast("double")), "f_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "f_symbols": F.log1p(100 * share("n_symbols", n)), "f_lines": share("n_dup_lines", F.col("n_lines")), "f_repeats": share("n_repeat_words", n),
    })


def _quantile(value: Column, share: float, step: float) -> Column:
    """The quantile of values rounded to a step: counts per step, so bounded, exact to the step and the same in each run."""
    return F.percentile(F.round(value / step) * step, share)


def _same(columns: list[str]) -> list[Column]:
    """Columns that are equal in all rows of a group, as aggregates."""
    return [F.first(c).alias(c) for c in columns]


def _with(df: DataFrame, of_groups: DataFrame, few: bool, by: list[str] = GROUP) -> DataFrame:
    """Each row with its group's figures; the columns of `by` are never null. A group may hold a third of all rows; its figures are few rows, which are broadcast if they are counted to be few in all."""
    return df.join(F.broadcast(of_groups) if few else of_groups, by)


def _moments(df: DataFrame, values: dict[str, Column], same: list[str]) -> DataFrame:
    names, columns = list(values), list(values.values())
    sums = [F.sum(c).alias(f"s_{k}") for k, c in values.items()]
    cross = [F.sum(columns[i] * columns[j]).alias(f"q_{names[i]}_{names[j]}") for i in range(len(names)) for j in range(i + 1)]
    return df.groupBy(*KEY).agg(F.count("*").alias("n"), *sums, *cross, *_same(same))


def _whitening(m: DataFrame, covariance, keep: list[Column]) -> DataFrame:
    """w_i_j, the inverse of the Cholesky factor of a group's covariance(i, j), and logdet, the logarithm of its determinant."""
    df, d = m, len(NAMES)
    for i in range(d):
        for j in range(i + 1):
            c = covariance(i, j)
            for k in range(j):
                c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l_{j}_{j}"))
    for j in range(d):
        for i in range(j, d):
            x = F.lit(1.0) if i == j else -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0))
            df = df.withColumn(f"w_{i}_{j}", x / F.col(f"l_{i}_{i}"))
    logdet = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(d)), F.lit(0.0))
    return df.select(*KEY, *keep, *(f"w_{i}_{j}" for i in range(d) for j in range(i + 1)), logdet.alias("logdet"))


def _distance() -> Column:
    z = [sum((F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(len(NAMES))]
    return sum((x * x for x in z), F.lit(0.0))


def _starts(df: DataFrame, few: bool) -> DataFrame:
    """Three deterministic first estimates of each group: medians with the absolute deviations from them, uncorrelated (0), and with
    the correlations of the hyperbolic tangents (1) and of the spatial signs (2) of the standardised features."""
    d = range(len(NAMES))
    mid = cut(df.groupBy(*GROUP).agg(*(_quantile(F.col(c), 0.5, 0.01).alias(f"m_{i}") for i, c in enumerate(NAMES))))
    off = [F.greatest(1.4826 * _quantile(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5, 0.01), F.lit(FEATURES[c])).alias(f"d_{i}") for i, c in enumerate(NAMES)]
    centre = cut(_with(df, mid, few).groupBy(*GROUP).agg(*off, *_same([f"m_{i}" for i in d])))
    z = [(F.col(c) - F.col(f"m_{i}")) / F.col(f"d_{i}") for i, c in enumerate(NAMES)]
    norm = F.sqrt(F.greatest(sum((x * x for x in z), F.lit(0.0)), F.lit(1e-12)))
    changed = {0: [F.lit(0.0) for _ in z], 1: [F.tanh(x) for x in z], 2: [x / norm for x in z]}
    ways = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), *(x.alias(f"u_{i}") for i, x in enumerate(u))) for k, u in changed.items())))
    kept = [f"{k}_{i}" for k in "md" for i in d]
    rows = _with(df, centre, few).select(*GROUP, *kept, ways.alias("u")).select(*GROUP, *kept, "u.*")

    def covariance(i: int, j: int) -> Column:
        floor = F.lit(1e-3) * F.col("n")
        r = F.col(f"q_{i}_{j}") / F.sqrt((F.col(f"q_{i}_{i}") + floor) * (F.col(f"q_{j}_{j}") + floor))
        return F.col(f"d_{i}") * F.col(f"d_{j}") * (r if i != j else F.lit(1.0))

    m = _moments(rows, {str(i): F.col(f"u_{i}") for i in d}, kept)
    return cut(_whitening(m, covariance, [F.col(f"m_{i}") for i in d]))


def estimates(df: DataFrame, few: bool) -> DataFrame:
    """Per group, the means and the whitening of least determinant that concentration steps come to from several starts, and scale,
    which brings the median squared distance to that of a normal distribution (never below 1). few: the groups are few enough to
    be broadcast."""
    far = F.log1p(_distance())  # distances lie over many powers of ten

    def covariance(i: int, j: int) -> Column:
        c = F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"s_{i}") * F.col(f"s_{j}") / (F.col("n") * F.col("n"))
        return c + F.lit(FEATURES[NAMES[i]] ** 2) if i == j else c

    means = [(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(NAMES))]
    values = {str(i): F.col(c) for i, c in enumerate(NAMES)}
    now = _starts(df, few)
    own = [c for c in now.columns if c not in KEY]
    for step in range(STEPS):
        near = cut(_with(df, now, few).groupBy(*KEY).agg(_quantile(far, KEPT, 0.01).alias("at"), *_same(own)))
        m = _moments(_with(df, near, few).where(far <= F.col("at") + 0.005), values, ["logdet"]).withColumnRenamed("logdet", "before")
        now = cut(_whitening(m, covariance, [F.col("before"), *means]))
        fell = now.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        now = now.drop("before")
        if step and (fell is None or fell < SETTLED):
            break
    best = now.groupBy(*GROUP).agg(F.min_by(F.struct(*own), F.struct("logdet", "start")).alias("b")).select(*GROUP, "b.*")
    scale = F.greatest(F.lit(1.0), F.expm1(_quantile(far, 0.5, 0.01)) / MEDIAN).alias("scale")
    return cut(_with(df, cut(best), few).groupBy(*GROUP).agg(scale, *_same(own)))


def _judged(rows: DataFrame, cutoff: float, own: int, few: int) -> DataFrame:
    """Adds distance and kept to rows with lang, source, the counts and the features; the rows are read in each step."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    named = rows.withColumns({"g_lang": key("lang"), "g_source": key("source")})
    sizes = cut(named.where("not base_failed").groupBy(*GROUP).agg(F.count("*").alias("rows")))
    held, small_rows = sizes.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("rows") < own, F.col("rows"))), F.lit(0))).first()
    hint = len(KEY) * held <= SMALL
    # small groups are one; its name is none that a value can give
    alone = F.col("rows") >= own
    place = sizes.select(*GROUP, *(F.when(alone, F.col(c)).otherwise("small").alias(k) for c, k in zip(GROUP, "ls", strict=True)), F.when(alone, F.col("rows")).otherwise(small_rows).alias("rows_of_group"))
    sound = _with(named.where("not base_failed"), place, hint).drop(*GROUP).withColumnsRenamed({"l": "g_lang", "s": "g_source"})
    found = estimates(sound.select(*GROUP, *NAMES), hint)
    figures = cut(place.join(found.withColumnsRenamed({"g_lang": "l", "g_source": "s"}), ["l", "s"]).drop("l", "s"))
    judged = named.join(F.broadcast(figures) if hint else figures, GROUP, "left")
    distance = F.when(F.col("base_failed"), F.lit(None)).when(F.col("rows_of_group") >= few, _distance() / F.col("scale")).otherwise(0.0)
    judged = judged.withColumn("distance", distance.cast("double"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff)).select(*rows.columns, "distance", "kept")


def judge(docs: DataFrame, cutoff: float = CUTOFF, own: int = OWN, few: int = FEW) -> DataFrame:
    """The counts of every row of docs (doc_id, text, lang, source), its squared distance from its group, and kept.

    kept is false where the base rules fail, or where the robust squared Mahalanobis distance from what is usual in the
    row's language and source is over the cutoff. Rows that fail the base rules take no part in the estimates; groups of fewer
    than own rows are one group, and in one of fewer than few nothing is an outlier. Null texts count as empty (no words: they
    fail); a null language or source is a value of its own; repeated rows count each, and rows that are alike are judged
    alike; long texts are read whole; an empty table gives no rows. Other columns are ignored.
    """
    judged = _judged(cut(features(counts(docs))), cutoff, own, few)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, own: int = OWN, few: int = FEW) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns, whatever these are called; none of an empty table.

    The rows are written once with their counts beside them; the estimates read the counts alone, and no text is moved.
    """
    row = F.col("row")
    held = docs.select(F.struct("*").alias("row")).select("row", row["lang"].alias("lang"), row["source"].alias("source"), row["text"].alias("text"))
    return _judged(stored(features(_counted(held))), cutoff, own, few).where("kept").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
