"""Canonical names and aliases as relations, against the rules told for one document."""

import random
from collections import defaultdict

from loomspan.functions.names import claim_key
from loomspan.operators import judging
from loomspan.operators.rows import written

SCHEMA = "doc_id string, source string, ord int, name string, type string, mentions array<string>"


def ent(source, at, name, kind, *mentions):
    return "d1", source, at, name, kind, list(mentions)


def canonical(rows):
    """Names put together in order, one entity after the other."""
    can = {}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    for _, _, _, name, _, mentions in order:
        names = [name, *(mentions or [])]
        owner = next((can[claim_key(m)] for m in names if claim_key(m) in can), name)
        for m in names:
            if m[:1].isupper() or m == name:
                can.setdefault(claim_key(m), owner)
    listed = defaultdict(set)
    for _, _, _, name, kind, mentions in order:
        for m in mentions or []:
            if not m[:1].isupper() and m != name:
                listed[claim_key(m), kind].add(can[claim_key(name)])
    for _, _, _, name, kind, _ in order:
        owners = listed[claim_key(name), kind]
        if len(owners) == 1 and not name[:1].isupper():
            can[claim_key(name)] = next(iter(owners))
    return can


def groups(rows):
    """Groups of names by merging sets."""
    types = defaultdict(set)
    for _, _, _, name, kind, mentions in rows:
        for m in [name, *(mentions or [])]:
            types[claim_key(m)].add(kind)
    sets = []
    for _, _, _, name, kind, mentions in rows:
        own = {claim_key(m) for m in [name, *(mentions or [])] if (m == name or m[:1].isupper() or m[:1].isdigit()) and types[claim_key(m)] == {kind} and claim_key(m)}
        touching = [s for s in sets if s & own]
        sets = [s for s in sets if not s & own] + [own.union(*touching)]
    return {frozenset(s) for s in sets if len(s) > 1}


def told(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    can, alias = defaultdict(dict), defaultdict(lambda: defaultdict(set))
    for r in judging.canonical_names(df, written).collect():
        can[r.doc_id][r.key] = r.canonical
    for r in judging.labelled_aliases(df, written).collect():
        assert r.canonical <= r.name
        alias[r.doc_id][r.canonical].add(r.name)
    return can, {d: {frozenset(x) for x in g.values()} for d, g in alias.items()}


CASES = [
    [ent("a", 0, "Anna Berg", "Person"), ent("a", 1, "Acme", "Org", "the firm"), ent("b", 0, "the firm", "Org"), ent("b", 1, "Per Lund", "Person")],
    [ent("a", 0, "Acme", "Org", "Acme AB"), ent("b", 0, "Acme", "Company", "ACME Group"), ent("c", 0, "Acme Group", "Org")],
    [ent("a", 0, "Smith v. Jones", "Case", "No. 04-25", "the case"), ent("b", 0, "No 0425", "Case", "Smith"), ent("b", 1, "Smith", "Person")],
    [ent("a", 0, "x", "T", "y"), ent("a", 1, "y", "T", "x"), ent("b", 0, "A", "T", "x"), ent("b", 1, "B", "T", "x")],
    [ent("a", 0, "!!", "T", "A", "?"), ent("a", 1, "A\nB", "T", "a b", "1st"), ent("b", 0, "1st", "T", "A B"), ent("b", 1, "É", "T", "é", "O’Neil", "O'Neil")],
    [ent("a", 0, "A", None, "B"), ent("b", 0, "B", None)],
]


def test_cases_and_drawn_documents(spark):
    rng = random.Random(4)
    names = ["A", "B", "a", "b", "C d", "c D", "the x", "The x", "x", "y", "1", "E.", "e", "F", "G", "h h", "H h"]
    rows = [(f"c{k}", *r[1:]) for k, case in enumerate(CASES) for r in case]
    rows += [(f"d{d}", s, k, rng.choice(names), rng.choice(["T", "T", "U"]), rng.sample(names, rng.randint(0, 3))) for d in range(80) for s in "abc" for k in range(rng.randint(0, 5))]
    can, alias = told(spark, rows)
    for d in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == d]
        assert can[d] == canonical(own) and alias.get(d, set()) == groups(own)


def test_facts_fold_names_by_their_keys(spark):
    claims = spark.createDataFrame([("d1", "Acme AB", "OWNS", "B.", ["s1"], False), ("d1", "ACME", "OWNS", "b", ["s2"], True), ("d1", "Z", "OWNS", "b", ["s2"], False)], "doc_id string, src string, type string, tgt string, sources array<string>, is_true boolean")
    alias = judging.labelled_aliases(spark.createDataFrame([ent("g", 0, "Acme AB", "Org", "Acme")], SCHEMA), written)
    got = {(r.src, r.tgt): (r.sources, r.is_true) for r in judging.facts(claims, alias).collect()}
    assert got == {("acme", "b"): (["s1", "s2"], True), ("z", "b"): (["s2"], False)}


def test_swaps_and_facts_of_the_world(spark):
    pool = spark.createDataFrame([("d", f"A{k}", "OWNS", "B") for k in range(30)], "doc_id string, src string, type string, tgt string")
    names = spark.createDataFrame([("d", "Acme, Inc.", "Org"), ("e", "Other", "Org")], "doc_id string, name string, type string")
    near = spark.createDataFrame([("OWNS", "LIKES")], "type string, other string")
    world = spark.createDataFrame([(s, "OWNS", f"T{k}") for k in range(40) for s in ("ACME INC", "Nobody")] + [("Acme Inc", "OWNS", "T0")], "src string, type string, tgt string")
    got = judging.decoys(pool, set(), near, names, 30, {"OWNS": "HELD"}, world).collect()
    assert {r.type for r in got if r.kind == "type"} == {"HELD"}
    assert {r.type for r in judging.decoys(pool, set(), near, names, 30).collect() if r.kind == "type"} == {"LIKES"}
    planted = [r for r in got if r.kind == "world"]
    assert {(r.doc_id, r.src) for r in planted} <= {("d", "ACME INC"), ("d", "Acme Inc")} and 10 < len(planted) < 31
