from loomspan.functions import answers, matching, names, segment, validate
from loomspan.functions.resolve import Entity, best_name, resolve
from loomspan.operators import labels, ontology
from loomspan.operators.schemas import BUSINESS


def words(text):
    return len(text.split())


def test_chunks_are_slices_and_limited():
    text = "\n\n".join(f"Paragraph {k} has a few words. Another sentence follows here." for k in range(30))
    own = segment.chunk(text, 30)
    assert [c.index for c in own] == list(range(len(own))) and own[-1].end == len(text)
    assert all(text[c.start : c.end] == c.text and words(c.text) <= 30 for c in own)
    assert all(b.start < a.end for a, b in zip(own, own[1:], strict=False))
    assert segment.chunk("") == [] and segment.chunk(" \n ") == []


def test_long_sentences_fall_back_to_lines_and_windows():
    lines = "\n".join(" ".join(f"l{k}w{i}" for i in range(8)) for k in range(5))
    assert all(words(c.text) <= 10 for c in segment.chunk(lines, 10))
    one = segment.chunk(" ".join(["x"] * 100), 10)
    assert len(one) > 1 and all(words(c.text) <= 10 for c in one)


def test_dense_blocks_carry_context():
    rows = "\n".join(f"| Name {k} | Role {k} of the board |" for k in range(60))
    text = f"# Staff\n\n| Name | Role |\n|---|---|\n{rows}\n\nThe end."
    own = [c for c in segment.chunk(text, 200, 40) if c.dense]
    assert len(own) > 1 and own[-1].context == "# Staff\n| Name | Role |\n|---|---|" and own[-1].model_text.startswith("# Staff")
    items = "\n".join(f"- item number {k} is here" for k in range(60))
    listed = [c for c in segment.chunk(f"The board consists of:\n\n{items}", 200, 40) if c.dense]
    assert all(c.context == "The board consists of:" for c in listed) and len(listed) > 1


def test_sentences():
    text = "Ida K. Moen wrote to Dr. Falk. Nobody answered? Soon\nshe phoned."
    cut = [text[a:b] for a, b in segment.numbered_sentences(text)]
    assert cut == ["Ida K. Moen wrote to Dr. Falk.", "Nobody answered?", "Soon\nshe phoned."]
    assert [text[a:b] for a, b in segment.sentences(text)][-1] == "she phoned."
    table = "Intro here.\n| a | b |\n|---|---|\n| c | d |\nEnd."
    assert [table[a:b].strip() for a, b in segment.numbered_sentences(table)] == ["Intro here.", "| a | b |", "| c | d |", "End."]
    spans = segment.sentences("One. Two. Three.")
    assert segment.sentence_at(spans, 6) == spans[1] and segment.sentence_at(spans, 4) is None
    windows = segment.sentence_windows("Aa bb. Cc dd. Ee ff. Gg hh.", 14)
    assert len(windows) > 1 and all(a[0] < b[0] for a, b in zip(windows, windows[1:], strict=False))


def test_tidy():
    raw = "The harbour office reported that twelve fer-\nries had been moved to the northern\nquay before the storm.\n\nNone was damaged."
    assert segment.tidy(raw) == "The harbour office reported that twelve ferries had been moved to the northern quay before the storm.\n\nNone was damaged."
    pages = "\n\n".join(f"HARBOUR NEWS\n\nFerry number {k} left the quay.\nPage {k}" for k in (4, 5, 6))
    out = segment.tidy(pages)
    assert "HARBOUR NEWS" not in out and "Page" not in out and "Ferry number 5 left" in out
    assert segment.tidy("A &amp; B owns it .").endswith("A & B owns it.")
    word = segment.tidy("Contents\n\nSummary..........2\n\nIt agreed.6 Ana spoke.\n\n\tfirst point\n\n{ PAGE }\n\nThe end.")
    assert "....." not in word and "{ PAGE }" not in word and "agreed. Ana" in word and "- first point" in word


def test_tables_as_sentences():
    assert segment.verbalize("| Name | Role |\n|---|---|\n| Ana | Chair |\n| Name | Role |\n| Ben | |") == "Name: Ana; Role: Chair.\nName: Ben."
    assert segment.verbalize("| Founded | 1990 |\n| Seat | Oslo. |") == "Founded: 1990.\nSeat: Oslo."


def test_name_classes():
    assert names.normalised("The Acme Robotics A.B.") == "acme robotics" and names.normalised("AB") == "ab"
    assert names.generic("the company") and names.generic("its parent company") and names.generic("She")
    assert not names.generic("the Norwegian company") and not names.generic("US") and names.generic("company")
    assert names.identifying("Amundsen") and not names.identifying("the CEO") and not names.identifying("The Company") and not names.identifying("AND")
    assert names.described("The company") == "company" and names.display_name(["the firm", "Acme", "Acme AB"]) == "Acme AB"


def test_matchers():
    assert matching.find_all("Acme and Acme's, Acmeville; new\n  york", "Acme") == [(0, 4), (9, 13)]
    assert matching.find_all("in new\n  york", "new york") == [(3, 13)] and matching.find_all("x", " ") == []
    assert matching.word_spans("a_b a b", "a") == [(4, 5)]
    spans, missing = matching.resolve_spans("Maria Lind met Lind.", {"e1": ["Maria Lind"], "e2": ["Lind", "Nobody"]})
    assert spans == {"e1": [(0, 10)], "e2": [(15, 19)]} and missing == 1
    assert matching.locate("Acme\n\nAcme grew here and there.", "Acme", [(0, 4)], 100) == [106]
    assert matching.place_generic([5, 30], [20]) == 30


TEXT = "Maria Lind leads Acme Robotics AB. She lives in Oslo. The company is based in Bergen."
RAW = "E1 Person: Maria Lind | She\nE2 Org: Acme Robotics AB | The company\nE3 Place: Oslo\nE4 Place: Bergen\nS1\nR EXECUTIVE_OF E1 E2 asserted title=leader\nS2\nR LOCATED_IN E1 E3 asserted\nS3\nR HEADQUARTERED_IN E2 E4 asserted"


def test_answers_round_trip_and_are_checked():
    r = validate.finish("sentences", RAW + "\nS9\nR BORN_IN E1 E3 asserted\nnoise", TEXT, BUSINESS)
    assert (len(r.entities), len(r.relations), r.unresolved_evidence, r.error) == (4, 3, 1, None)
    for fmt in ("lines", "sentences", "json"):
        said = answers.encode(fmt, r.entities, r.relations, TEXT, BUSINESS.attribute_keys())
        again = answers.decode(fmt, said, TEXT)[0]
        assert again["relations"] == r.relations and [e["mentions"] for e in again["entities"]] == [e["mentions"] for e in r.entities]
    assert answers.decode("json", "no object", "")[1] == "no JSON object"
    assert answers.decode("lines", "garbage", "")[1] == "lines: no parseable line (1 malformed)"
    assert answers.decode("json", 'so: ```json\n{"entities": []}\n```', "")[0] == {"entities": []}


def test_repeats_end_a_block():
    said = "E1 Person: A\nS1\nR MET_WITH E1 E2 asserted\nS2\nR MET_WITH E1 E2 asserted\nR MET_WITH E1 E3 asserted\nS3\nR MET_WITH E1 E3 asserted"
    assert answers.drop_repeats(said) == "E1 Person: A\nS1\nR MET_WITH E1 E2 asserted\nS2\nR MET_WITH E1 E2 asserted\nS3\nR MET_WITH E1 E3 asserted"


def _e(i, kind, *names_):
    return {"id": i, "type": kind, "name": names_[0], "attributes": {}, "mentions": list(names_)}


def _r(kind, a, b, **more):
    return {"type": kind, "source": a, "target": b, "modality": "asserted", "evidence": "", "attributes": {}} | more


def test_lenient_repairs_retypes_and_drops():
    found = {"entities": [_e("e1", "Place", "Acme"), _e("e2", "Place", "Oslo"), _e("e3", "Nothing", "x")], "relations": [_r("HEADQUARTERED_IN", "e1", "e2"), _r("BORN_IN", "e1", "e3"), _r("NO_SUCH", "e1", "e2")]}
    r = validate.lenient(found, BUSINESS)
    assert r.entities[0]["type"] == "Org" and (r.retyped_entities, r.unknown_types, r.dropped_relations) == (1, 1, 2)
    found = {"entities": [_e("e1", "Place", "Here"), _e("e2", "Coordinate", "1, 2")], "relations": [_r("HELD_AT", "e1", "e2", attributes={"role": "x"})]}
    r = validate.lenient(found, BUSINESS, retype=False)
    assert r.relations[0]["type"] == "HAS_COORDINATE" and r.relations[0]["attributes"] == {} and r.repaired_relations == 1
    many = {"entities": [_e(f"e{k}", "Person", f"P{k}") for k in range(41)], "relations": []}
    assert validate.lenient(many, BUSINESS).over_cap
    assert validate.strict_errors([_e("e1", "Person", "a")], [_r("BORN_IN", "e1", "e9")], BUSINESS) == ["BORN_IN without an end"]


def test_schema_checks_and_variants():
    import pytest

    for bad in (
        dict(entities=("A", "A"), relations=()),
        dict(entities=("A",), relations=(ontology.relation("A", "A", "A"),)),
        dict(entities=("A",), relations=(ontology.relation("Knows", "A", "B"),)),
        dict(entities=("A",), relations=(ontology.relation("Knows", "A", "A", aliases=("A",)),)),
    ):
        with pytest.raises(ValueError):
            ontology.Schema("bad", tuple(map(ontology.EntityType, bad["entities"])), bad["relations"])
    assert len(BUSINESS.relations) == 21 and BUSINESS.symmetric() == {"FAMILY_OF", "ASSOCIATE_OF", "MET_WITH", "COMMUNICATED_WITH"}
    assert BUSINESS.canonical("MET_WITH", "e2", "e1") == ("MET_WITH", "e1", "e2") and BUSINESS.canonical("MET_WITH", "e2", None) == ("MET_WITH", "e2", None)
    assert BUSINESS.only_edge("Place", "Coordinate") == "HAS_COORDINATE" and BUSINESS.only_edge("Person", "Org") is None
    small, renamed = BUSINESS.variant(3)
    assert BUSINESS.variant(3) == (small, renamed) and {r.name for r in small.relations} == set(renamed.values())
    with pytest.raises(KeyError):
        ontology.registered("no such schema")


def _entity(chunk, i, kind, *mentions):
    own = [m if isinstance(m, tuple) else (m, None) for m in mentions]
    return Entity(chunk, i, kind, own[0][0], own)


def n_groups(*entities, **how):
    return len(resolve(list(entities), **how).held)


def test_resolution_rules():
    assert n_groups(_entity(0, "e1", "Org", ("Acme", 5)), _entity(1, "e1", "Org", ("ACME", 5))) == 1
    assert n_groups(_entity(0, "e1", "Org", "The Acme Robotics Ltd"), _entity(1, "e1", "Org", "Acme Robotics")) == 1
    assert n_groups(_entity(0, "e1", "Org", "Acme"), _entity(1, "e1", "Place", "Acme")) == 2
    assert n_groups(_entity(0, "e1", "Person", "She"), _entity(1, "e1", "Person", "She")) == 2
    assert n_groups(_entity(0, "e1", "Org", "Acme"), _entity(0, "e2", "Org", "Acme")) == 2
    assert n_groups(_entity(0, "e1", "Org", "Acme", "the company"), _entity(1, "e1", "Org", "the company")) == 1
    assert n_groups(_entity(0, "e1", "Org", "Acme", "the company"), _entity(0, "e2", "Org", "Beta", "the company"), _entity(1, "e1", "Org", "the company")) == 3
    assert n_groups(_entity(0, "e1", "Person", "Anna Holm"), _entity(1, "e1", "Person", "Bo Holm"), _entity(2, "e1", "Person", "Holm"), _entity(3, "e1", "Person", "Holm")) == 4
    assert n_groups(_entity(0, "e1", "Person", "Anna Holm"), _entity(1, "e1", "Person", "Holm")) == 1
    assert n_groups(_entity(0, "e1", "Org", "Norsk Bank"), _entity(1, "e1", "Org", "the bank")) == 1
    assert n_groups(_entity(0, "e1", "Org", "Norsk Bank"), _entity(1, "e1", "Org", "the bank"), carry_forward=False) == 2
    assert n_groups(_entity(0, "e1", "Org", "Acme"), _entity(3, "e1", "Org", "Beta"), carried=True) == 1
    log = resolve([_entity(0, "e1", "Org", "Acme AB"), _entity(1, "e4", "Org", "Acme")]).log
    assert log == [("b", (0, "e1"), (1, "e4"))] and best_name(["the firm", "Acme", "Acme AB"]) == "Acme AB"


def test_corrections():
    es = [_e("e1", "Person", "Maria Lind"), _e("e2", "Org", "Acme Robotics AB")]
    rs = [_r("EXECUTIVE_OF", "e2", "e1")]
    lines = ["flip R1", "entity E7 Place: Oslo | Nowhere", "add LOCATED_IN E1 E7", "mention E1: She", "retype E9 Org", "what is this", "drop R7", "entity E8 Thing: Oslo", "add LOCATED_IN E1 E7", "add MET_WITH E1", "mention E1: absent"]
    entities, relations, skipped, error = labels.corrected(TEXT, es, rs, lines, BUSINESS)
    assert error is None and skipped == 5 and [(r["type"], r["source"], r["target"]) for r in relations] == [("EXECUTIVE_OF", "e1", "e2"), ("LOCATED_IN", "e1", "e7")]
    assert entities[0]["mentions"] == ["Maria Lind", "She"] and entities[2] == _e("e7", "Place", "Oslo")
    two = [_r("EXECUTIVE_OF", "e1", "e2"), _r("EMPLOYED_BY", "e1", "e2"), _r("BOARD_MEMBER_OF", "e1", "e2")]
    assert [r["type"] for r in labels.corrected(TEXT, es, two, ["drop R1 R2"], BUSINESS)[1]] == ["BOARD_MEMBER_OF"]


def test_corrections_beyond_the_limit():
    text = " ".join(f"N{k}" for k in range(60))
    es = [_e(f"e{k}", "Org", f"N{k}") for k in range(1, 39)]
    more = [f"entity E{k} Org: N{k}" for k in range(39, 46)] + ["add SUBSIDIARY_OF E45 E1"]
    entities, relations, skipped, error = labels.corrected(text, es, [], more, BUSINESS)
    assert error is None and skipped == 5 and len(entities) == 40 and [e["id"] for e in entities][-2:] == ["e39", "e45"] and len(relations) == 1


def test_a_schema_of_ones_own():
    toy = ontology.Schema("toy", tuple(ontology.EntityType(n) for n in ("Dept", "Proj", "Pers")), (ontology.relation("RunsProject", "Dept", "Proj"), ontology.relation("Colleague", "Pers", "Pers", symmetric=True)))
    es = [_e("e1", "Dept", "Grid"), _e("e2", "Proj", "Saltdal"), _e("e3", "Pers", "Tor"), _e("e4", "Pers", "Kari")]
    lines = ["entity E5 Proj: Fjordvann", "add RUNS_PROJECT E1 E5", "add COLLEAGUE E3 E4", "add RUNS_PROJECT E3 E2", "entity E6 Org: Grid"]
    entities, relations, skipped, _ = labels.corrected("Grid Saltdal Tor Kari Fjordvann", es, [_r("RUNS_PROJECT", "e1", "e2")], lines, toy)
    assert {(r["type"], r["source"], r["target"]) for r in relations} == {("RUNS_PROJECT", "e1", "e2"), ("RUNS_PROJECT", "e1", "e5"), ("COLLEAGUE", "e3", "e4")}
    assert {e["type"] for e in entities} == {"Dept", "Proj", "Pers"} and skipped == 2
