"""Spans of texts as gaps and islands, by DataFrame functions alone: texts are cut at places without width, so that the lengths of the
pieces add up to offsets; windows number the islands, and a fold packs units into chunks.

Keys must be unique. A null text counts as empty and has no spans. Texts are dealt out by key once; from then on all windows and groups of
a key find its rows together. One row holds a piece, none a document's pieces; a chunk's text is cut from the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space as the functions for one text see it, and a class of it in a pattern.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
S = r"[\s\x1C-\x1F\u0085\p{Z}]"
# Where texts are cut. Each place lies before the white space of a break.
AT_SENTENCE = r"(?U)(?<=[.!?])(?=[ \t]+[A-Z\"'“‘\d])|(?=\n)"
AT_LINE = r"(?=\n)"
AT_BLANK = r"(?=\n[ \t\r]*\n)"
AT_NUMBERED = rf"(?<=[.!?])(?={S}+[A-Z\"'(\[])"
ROW_LINE = r"[ \t]*\|[^\n]*\|[ \t]*"
AT_ROW = rf"(?:^|(?<=\n))(?={ROW_LINE}(?:\n|\z))"
RULE_LINE = rf"^[ \t]*\|(?:{S}|[:|-])*\|[ \t]*\z"
NO_BREAK = r"(?U)(?:(?<![\w.])[A-Z]|\b(?:Mr|Mrs|Ms|Dr|St|Jr|Sr|Prof|Gen|Col|Lt|Mt|Rev|lit|approx|vs|No|no))\.\z"
LAYOUT = r"(?U)^\s*(\||[-*•]\s|\d+[.)]\s|(\*\*)?[A-Z][\w /&().-]{0,40}(\*\*)?:(\*\*)?\s)"
HEADING = r"(?U)^#{1,6}\s+\S"
HEADING_BULLET = r"(?U)^\s*([-*•–]|\d+[.)]|[a-z][.)])\s"
CLOSED = r"[.!?:;,\"')”]\z"

size = F.char_length


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def lead_of(text: Column) -> Column:
    """How much white space a piece begins with; all of a blank one."""
    return size(text) - size(F.ltrim(text, F.lit(WHITE)))


def words_in(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, rf"{S}+"), lambda w: w != ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which the value is worked out once, even where lambdas within name it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """k from 0 in the order given."""
    return df.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def spans(docs: DataFrame, cuts: Column, key: str = "doc_id") -> DataFrame:
    """key, k, start, end, text of the pieces, an array that makes up the text, without the white space around each; blank ones are left out."""
    piece = docs.select(key, F.posexplode(cuts).alias("_i", "_piece"))
    piece = piece.select(key, "_i", size("_piece").alias("_n"), lead_of(F.col("_piece")).alias("_lead"), trimmed(F.col("_piece")).alias("text"))
    piece = piece.withColumn("_size", size("text"))
    before = W.partitionBy(key).orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_lead")
    found = _numbered(piece.withColumn("_at", at).where("_size > 0"), key, "_i")
    return found.select(key, "k", F.col("_at").cast("int").alias("start"), (F.col("_at") + F.col("_size")).cast("int").alias("end"), "text")


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document sentences: a mark before a capital, quote or digit ends one, and so does every line break."""
    return spans(docs, F.split("text", AT_SENTENCE), key)


def paragraph_cuts(text: str = "text") -> Column:
    blank = trimmed(F.col(text)).rlike(r"\n[ \t\r]*\n")
    return F.when(blank, F.split(text, AT_BLANK)).otherwise(F.split(text, AT_LINE))


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cut at blank lines; where there are none, at every line break."""
    return spans(docs, paragraph_cuts(), key)


def numbered_sentences(docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The sentences that answers number: initials and titles end none, each table row is one, rule rows are none.

    A piece that a title or an initial ends goes on: islands of pieces are sentences.
    """
    row = lambda part: F.regexp_extract(part, rf"^{ROW_LINE}(?=\n|\z)", 0)

    def prose(parts: Column) -> Column:
        def piece(p: Column, j: Column) -> Column:
            last = F.array_join(F.slice(parts, F.greatest(F.lit(1), j - 3), F.least(j, F.lit(4))), "")  # eight characters at least
            begins = (j == 0) | ~F.coalesce(F.substring(last, -8, 8), F.lit("")).rlike(NO_BREAK)
            gap = lambda b: F.when((j > 0) & b, lead_of(p)).otherwise(0)
            return let(begins, lambda b: F.struct(p.alias("text"), b.alias("begins"), gap(b).alias("gap"), (trimmed(p) != "").alias("filled")))

        return F.transform(parts, piece)

    def part(p: Column) -> Column:
        own = row(p)
        head = F.filter(F.array(F.struct(own.alias("text"), F.lit(True).alias("begins"), F.lit(0).alias("gap"), (~own.rlike(RULE_LINE)).alias("filled"))), lambda x: x["text"] != "")
        rest = p.substr(size(own) + 1, size(p))
        return F.concat(head, let(F.split(rest, AT_NUMBERED), prose))

    rows = F.when(F.col("text").contains("|"), F.split("text", AT_ROW)).otherwise(F.array("text"))
    pieces = F.when(F.col("text").isNotNull(), F.flatten(F.transform(rows, part)))
    piece = docs.select(key, F.posexplode(pieces).alias("_i", "_p")).select(key, "_i", "_p.*").withColumn("_n", size("text"))
    w = W.partitionBy(key).orderBy("_i")
    at = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = piece.withColumn("_at", at).withColumn("_run", F.sum(F.col("begins").cast("int")).over(w))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.expr("substring(text, gap + 1)").alias("t")))), lambda x: x["t"]), "")
    whole = placed.groupBy(key, "_run").agg(F.min(F.col("_at") + F.col("gap")).cast("int").alias("start"), F.max(F.col("_at") + F.col("_n")).cast("int").alias("end"), F.bool_or("filled").alias("filled"), said.alias("text"))
    return _numbered(whole.where("filled"), key, "_run").select(key, "k", "start", "end", "text")


def line_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i, at (where it begins) and line of all lines, blank ones too."""
    line = docs.select(key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return line.withColumn("at", F.coalesce(F.sum(size("line") + 1).over(before), F.lit(0)).cast("int"))


def headings(docs: DataFrame, most_words: int = 12, key: str = "doc_id") -> DataFrame:
    """Short lines that stand as headings: no mark at the end, no bullet, no short line right above or below, not the last line."""
    line = line_table(docs, key).where("line != ''").withColumn("short", words_in(F.col("line")).between(1, most_words))
    w = W.partitionBy(key).orderBy("i")
    beside = lambda move, step: F.coalesce((move("i").over(w) == F.col("i") + step) & move("short").over(w), F.lit(False))
    line = line.withColumn("crowded", beside(F.lead, 1) | beside(F.lag, -1)).withColumn("last", F.lead("i").over(w).isNull())
    found = line.where(F.col("short") & ~F.col("crowded") & ~F.col("last") & ~F.rtrim("line", F.lit(WHITE)).rlike(CLOSED) & ~F.col("line").rlike(HEADING_BULLET))
    return _numbered(found, key, "i").select(key, "k", F.col("at").alias("start"), (F.col("at") + size("line")).cast("int").alias("end"), F.col("line").alias("text"))


def verbalized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the text with each table's rows as sentences that name the columns; a null text stays null.

    Rows between two other lines are one table. Its header is the row above the first rule, else the first row; two columns without a rule
    are keys and values. Texts without a row aren't shuffled.
    """
    is_row = rf"^{ROW_LINE}\z"
    tabled = F.col("text").rlike(AT_ROW)
    line = docs.where(tabled).select(key, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    line = line.withColumn("row", F.col("line").rlike(is_row))
    body = F.trim(F.col("line"), F.lit(WHITE))
    cells = F.transform(F.split(body.substr(F.lit(2), size(body) - 2), r"\|"), trimmed)
    line = line.withColumn("cells", F.when(F.col("row"), cells)).withColumn("rule", F.col("row") & F.col("line").rlike(RULE_LINE))
    line = line.withColumn("table", F.sum((~F.col("row")).cast("int")).over(W.partitionBy(key).orderBy("i")))
    own = W.partitionBy(key, "table", "row")
    line = line.withColumn("nth", F.row_number().over(own.orderBy("i")) - 1)
    line = line.withColumn("first_rule", F.min(F.when(F.col("rule"), F.col("nth"))).over(own))
    at = lambda n: F.max(F.when(F.col("nth") == n, F.col("cells"))).over(own)
    ruled = F.coalesce(F.col("first_rule") > 0, F.lit(False))
    line = line.withColumn("first", at(0)).withColumn("above", at(F.col("first_rule") - 1))
    header = F.when(ruled, F.col("above")).when(F.size("first") != 2, F.col("first"))
    line = line.withColumn("header", header)
    inside = F.when(ruled, F.col("nth") > F.col("first_rule")).when(F.col("header").isNull(), F.lit(True)).otherwise(F.col("nth") > 0)
    kept = inside & ~F.col("rule") & ~F.coalesce(F.col("cells") == F.col("header"), F.lit(False))
    bare = F.when(F.size("cells") == 2, F.concat(F.col("cells")[0], F.lit(": "), F.col("cells")[1])).otherwise(F.array_join(F.filter("cells", lambda c: c != ""), "; "))
    pairs = F.filter(F.arrays_zip(F.col("header").alias("h"), F.slice("cells", F.lit(1), F.size("header")).alias("c")), lambda x: x["c"].isNotNull() & (x["c"] != "") & x["h"].isNotNull())
    named = F.array_join(F.transform(pairs, lambda x: F.when(x["h"] != "", F.concat(x["h"], F.lit(": "), x["c"])).otherwise(x["c"])), "; ")
    said = F.when(F.col("header").isNull(), bare).otherwise(named)
    line = line.withColumn("said", F.when(~F.col("row"), F.col("line")).when(kept, F.when(said.endswith("."), said).otherwise(F.concat(said, F.lit(".")))))
    again = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x["said"]), "\n")  # lines that are gone are null and left out
    changed = line.groupBy(key).agg(again.alias("text"))
    return docs.where(~F.coalesce(tabled, F.lit(False))).select(key, "text").unionByName(changed)


# --- chunks ---


def packed(units: Column, limit: Column) -> Column:
    """Neighbouring units (structs of start, end, words, in order) up to `limit` words, as (start, end). A piece after one of several
    units begins with the last of these, if the next fits beside it: a fold over the units."""
    none = F.array().cast("array<struct<start: int, end: int>>")
    whole = lambda c, n: c.cast("int").alias(n)
    begin = F.struct(none.alias("out"), *(whole(F.lit(0), n) for n in ("first", "last", "end", "words", "last_words", "held")))

    def step(a: Column, u: Column) -> Column:
        full = (a["held"] > 0) & (a["words"] + u["words"] > limit)
        again = full & (a["held"] > 1) & (a["last_words"] + u["words"] <= limit)
        alone = (a["held"] == 0) | full & ~again
        done = F.struct(a["first"].alias("start"), a["end"].alias("end"))
        return F.struct(
            F.when(full, F.array_append(a["out"], done)).otherwise(a["out"]).alias("out"),
            whole(F.when(alone, u["start"]).when(again, a["last"]).otherwise(a["first"]), "first"),
            whole(u["start"], "last"),
            whole(u["end"], "end"),
            whole(F.when(alone, u["words"]).when(again, a["last_words"] + u["words"]).otherwise(a["words"] + u["words"]), "words"),
            whole(u["words"], "last_words"),
            whole(F.when(alone, 1).when(again, 2).otherwise(a["held"] + 1), "held"),
        )

    finish = lambda a: F.when(a["held"] > 0, F.array_append(a["out"], F.struct(a["first"].alias("start"), a["end"].alias("end")))).otherwise(a["out"])
    return F.aggregate(units, begin, step, finish)


def blocks(docs: DataFrame, max_words: int = 200, dense_words: int | None = 80, key: str = "doc_id") -> DataFrame:
    """Paragraphs (key, k, start, end, text) with the block and run that they belong to.

    Three or more one-line layout paragraphs in a row are one block. A block over dense_words is dense if half or more of its three or
    more lines are rows, items or labelled values; one over max_words is long; others are short, and neighbouring short ones are one run.
    """
    p = paragraphs(docs, key).withColumn("words", words_in(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: trimmed(x) != "")
    p = p.withColumn("lines", F.size(lines)).withColumn("layout", F.size(F.filter(lines, lambda x: x.rlike(LAYOUT))))
    by_key = W.partitionBy(key).orderBy("k")
    one = ~F.col("text").contains("\n") & F.col("text").rlike(LAYOUT) if dense_words else F.lit(False)
    p = p.withColumn("one", one)
    p = p.withColumn("island", F.sum((~F.col("one")).cast("int")).over(by_key))
    island = W.partitionBy(key, "island", "one")
    p = p.withColumn("block", F.when(F.col("one") & (F.count(F.lit(1)).over(island) > 2), F.min("k").over(island)).otherwise(F.col("k")))
    own = W.partitionBy(key, "block")
    p = reduce(lambda d, c: d.withColumn(f"block_{c}", F.sum(c).over(own)), ("words", "lines", "layout"), p)
    p = p.withColumn("block_start", F.min("start").over(own)).withColumn("block_end", F.max("end").over(own))
    dense = (F.col("block_words") > (dense_words or 0)) & (F.col("block_lines") >= 3) & (2 * F.col("block_layout") >= F.col("block_lines")) if dense_words else F.lit(False)
    p = p.withColumn("kind", F.when(dense, "dense").when(F.col("block_words") > max_words, "long").otherwise("short"))
    opens = (F.col("k") == F.col("block")) & ((F.col("kind") != "short") | F.coalesce(F.lag("kind").over(by_key) != "short", F.lit(True)))
    p = p.withColumn("opens", opens)
    p = p.withColumn("run", F.sum(F.col("opens").cast("int")).over(by_key))
    return p.select(key, "k", "start", "end", "text", "words", "block", "block_start", "block_end", "block_words", "kind", "run")


def units(docs: DataFrame, max_words: int = 200, dense_words: int | None = 80, key: str = "doc_id") -> DataFrame:
    """key, run, kind, block_start, k, j, start, end, words: what chunks are packed of.

    A short block is one unit; of a long one sentences are, and of a sentence over max_words windows of half that; of a dense one lines.
    """
    half = max(1, max_words // 2)

    def windows(piece: Column) -> Column:
        """The piece in parts of `half` words; what follows its last word is a part too."""
        body = F.rtrim(piece, F.lit(WHITE))
        in_parts = lambda words: F.transform(F.sequence(F.lit(1), F.size(words), F.lit(half)), lambda i: F.array_join(F.slice(words, i, F.lit(half)), ""))
        parts = let(F.split(body, r"(?U)(?<=\S)(?=\s)"), in_parts)
        return F.when(words_in(piece) > max_words, F.array_append(parts, piece.substr(size(body) + 1, size(piece)))).otherwise(F.array(piece))

    b = blocks(docs, max_words, dense_words, key).where("kind != 'short' or k = block")
    cuts = F.when(F.col("kind") == "short", F.array("text")).when(F.col("kind") == "dense", F.split("text", AT_LINE)).otherwise(F.flatten(F.transform(F.split("text", AT_SENTENCE), windows)))
    u = b.select(key, "run", "kind", "block_start", "block_end", "block_words", "k", "start", F.posexplode(cuts).alias("j", "piece"))
    before = W.partitionBy(key, "k").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    u = u.withColumn("at", F.col("start") + F.coalesce(F.sum(size("piece")).over(before), F.lit(0)) + lead_of(F.col("piece"))).withColumn("n", size(trimmed(F.col("piece")))).where("n > 0")
    short = F.col("kind") == "short"
    start, end = F.when(short, F.col("block_start")).otherwise(F.col("at")), F.when(short, F.col("block_end")).otherwise(F.col("at") + F.col("n"))
    words = F.when(short, F.col("block_words")).otherwise(words_in(F.col("piece")))
    return u.select(key, "run", "kind", "block_start", "k", "j", start.cast("int").alias("start"), end.cast("int").alias("end"), words.cast("int").alias("words"))


def contexts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (of a filled line without its blanks), and what is above it: heading, rows (of the table that it stands in: header, rule, group) and lead.

    All by windows: the last heading; the first row of the island of rows; the last line with text.
    """
    line = line_table(docs, key)
    line = line.withColumn("said", trimmed(F.col("line"))).withColumn("row", F.ltrim("line", F.lit(WHITE)).startswith("|"))
    up = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumn("heading", F.last(F.when(F.col("line").rlike(HEADING), F.col("line")), ignorenulls=True).over(up))
    line = line.withColumn("lead", F.last(F.when(F.col("said") != "", F.col("said")), ignorenulls=True).over(up))
    line = line.withColumn("table", F.sum((~F.col("row")).cast("int")).over(W.partitionBy(key).orderBy("i")))
    own = W.partitionBy(key, "table", "row").orderBy("i")
    above = own.rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumn("nth", F.row_number().over(own) - 1)
    rule = trimmed(F.regexp_replace("line", r"\|", "")).rlike(r"^[-: ]*\z")
    full = F.filter(F.transform(F.split(F.trim(F.col("said"), F.lit("|")), r"\|"), trimmed), lambda c: c != "")
    line = line.withColumn("one_cell", (F.size(full) == 1) & ~rule & (F.col("nth") > 0)).withColumn("is_rule", rule)
    header = F.first("line").over(above)
    second = F.max(F.when((F.col("nth") == 1) & F.col("is_rule"), F.col("line"))).over(above)
    group = F.last(F.when(F.col("one_cell"), F.col("line")), ignorenulls=True).over(above)
    line = line.withColumn("header", header).withColumn("second", second).withColumn("group", group)
    inside = F.col("row") & (F.col("nth") > 0)
    fresh = F.col("group").isNotNull() & (F.col("group") != F.col("header")) & F.coalesce(F.col("group") != F.col("second"), F.lit(True)) & (trimmed(F.col("group")) != F.col("said"))
    rows = F.when(inside, F.array_compact(F.array(F.col("header"), F.col("second"), F.when(fresh, F.col("group"))))).otherwise(F.array().cast("array<string>"))
    announces = F.col("lead").endswith(":") & ~F.col("lead").rlike(LAYOUT)
    at = (F.col("at") + size("line") - size(F.ltrim("line", F.lit(WHITE)))).cast("int")
    return line.where("said != ''").select(key, at.alias("start"), F.coalesce("heading", F.lit("")).alias("heading"), rows.alias("rows"), F.when(announces, F.col("lead")).otherwise("").alias("lead"))


def chunks(docs: DataFrame, max_words: int = 200, dense_words: int | None = 80, key: str = "doc_id") -> DataFrame:
    """key, chunk, start, end, text, context, dense, model_text: pieces of whole paragraphs up to max_words.

    A block over max_words is cut at its sentences, a dense one over dense_words at its lines; each piece of a dense block has context:
    the heading above, inside a table its header, rule and group row, else the line that leads in. Only documents with a dense block are
    looked through for context.
    """
    texts = docs.where("text is not null").select(key, "text").repartition(F.col(key))
    u = units(texts, max_words, dense_words, key)
    limit = F.when(F.first("kind") == "dense", F.lit(dense_words or 0)).otherwise(F.lit(max_words))
    runs = u.groupBy(key, "run").agg(F.first("kind").alias("kind"), F.min("block_start").alias("block_start"), limit.alias("limit"), F.array_sort(F.collect_list(F.struct("k", "j", "start", "end", "words"))).alias("units"))
    piece = runs.select(key, "run", "kind", "block_start", F.posexplode(packed(F.col("units"), F.col("limit"))).alias("_n", "_p")).select(key, "run", "kind", "block_start", "_n", "_p.*")
    piece = piece.withColumn("chunk", F.row_number().over(W.partitionBy(key).orderBy("run", "_n")) - 1)
    piece = piece.join(texts.withColumnRenamed("text", "_whole"), key).withColumn("text", F.expr("substring(_whole, start + 1, end - start)")).drop("_whole")
    dense = F.col("kind") == "dense"
    if dense_words:
        may = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(LAYOUT))) > 2  # no text with fewer such lines has a dense block
        line = F.struct("heading", "rows", "lead")
        above = contexts(texts.where(may), key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("start", line))).alias("_above"))
        piece = piece.join(above, key, "left")
        at = lambda place: F.try_element_at("_above", F.col(place))
        heading, rows, lead = at("start")["heading"], at("start")["rows"], at("block_start")["lead"]
        lead = F.when((F.size(rows) == 0) & ~F.col("text").startswith(lead), lead).otherwise("")
        context = F.when(dense, F.array_join(F.filter(F.concat(F.array(heading, lead), rows), lambda x: x != ""), "\n")).otherwise("")
    else:
        context = F.lit("")
    piece = piece.withColumn("context", F.coalesce(context, F.lit("")))
    model = F.array_join(F.filter(F.array("context", "text"), lambda x: x != ""), "\n")
    return piece.select(key, F.col("chunk").cast("int").alias("chunk"), "start", "end", "text", "context", dense.alias("dense"), model.alias("model_text"))
