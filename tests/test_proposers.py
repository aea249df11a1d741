import json

import pytest

from loomspan import config
from loomspan.functions import answers, grammar, prompts, tagging
from loomspan.operators import ontology
from loomspan.operators.schemas import BUSINESS, SPORTS

TEXT = "Tove Brandt leads Nordvik Mills. The firm is based in Aalborg."
ANSWER = "E1 Person: Tove Brandt\nE2 Org: Nordvik Mills | The firm\nE3 Place: Aalborg\nS1\nR EXECUTIVE_OF E1 E2 asserted\nS2\nR HEADQUARTERED_IN E2 E3 asserted"


def test_chats():
    full = prompts.messages(TEXT, "sentences", BUSINESS)
    assert [m["role"] for m in full] == ["system", "user", "assistant", "user"]
    assert "HEADQUARTERED_IN" in full[0]["content"] and full[-1]["content"].startswith("S1: Tove Brandt leads")
    assert answers.decode("sentences", full[2]["content"], prompts.EXAMPLE)[0]["relations"][0]["type"] == "EXECUTIVE_OF"
    assert len(prompts.messages(TEXT, "lines", SPORTS)) == 2  # the example is of the business schema alone
    compact = prompts.messages(TEXT, "sentences", BUSINESS, "compact", known="E4 Org: Nordvik Mills")
    assert len(compact) == 2 and compact[-1]["content"].split("\n\n") == [f"{prompts.KNOWN}\nE4 Org: Nordvik Mills", answers.rendered(TEXT)]
    assert prompts.with_known("x", "  ") == "x"
    assert SPORTS.rendered() in prompts.messages(TEXT, "json", SPORTS, "conditioned")[0]["content"]
    template = lambda chat: "".join(f"<{m['role']}>{m['content']}" for m in chat) + "<end>"
    assert prompts.generation_prompt(template, compact) + "yes<end>" == prompts.rendered_chat(template, [*compact, {"role": "assistant", "content": "yes"}])


def test_formats_can_be_added():
    own = prompts.Format("csv", "one line each", str, lambda *a: "", lambda raw, text: ({"entities": [], "relations": []}, None))
    assert prompts.register_format(own) is prompts.register_format(own)
    with pytest.raises(ValueError):
        prompts.register_format(prompts.Format("csv", "another", str, own.encode, own.decode))
    assert "one line each" in prompts.system_prompt("csv", BUSINESS)
    del prompts.FORMATS["csv"]


def test_training_examples_and_tasks():
    found = answers.decode("sentences", ANSWER, TEXT)[0]
    example = prompts.training_example(TEXT, BUSINESS, found["entities"], found["relations"])["messages"]
    assert example[-1]["content"] == ANSWER
    rest = prompts.training_example(TEXT, BUSINESS, found["entities"], found["relations"], relations_only=True)["messages"]
    assert rest[-1]["content"].startswith("S1\nR ") and rest[-2]["content"].endswith("E3 Place: Aalborg")
    assert "There are 7 files in p" in prompts.labelling_task("p", "r", 7) and prompts.NO_CONVENTIONS in prompts.labelling_task("p", "r", 7, " ")
    assert json.loads(prompts.prompt_file("a#1", TEXT, BUSINESS))["chunk_id"] == "a#1" and prompts.file_name("a#1") == "a_1.json"
    assert "Sports" not in prompts.judging_brief(SPORTS) and "PLAYS_FOR" in prompts.judging_brief(SPORTS) and "verdicts.jsonl" in prompts.judge_task("b", "i", "verdicts.jsonl")
    assert prompts.training_run("sports", "lines", "compact", epochs=2) == {"schema": "sports", "format": "lines", "compact_prompt": True, "conditioned": False, "epochs": 2}


def test_questions_about_pairs():
    assert prompts.entity_block([("Org", ["Acme", "it"])]) == "E1 Org: Acme | it" and "Target: b" in prompts.question("a", "b", "c")


def test_grammar_follows_types_and_sentences():
    rules = dict(line.split(" ::= ", 1) for line in grammar.grammar(BUSINESS, n_sentences=2).splitlines())
    assert rules["root"] == "entity{0,40} block1? block2?" and rules["relation"].startswith('"R " etype') and '"BORN_IN"' in rules["etype"]
    types = {1: "Person", 2: "Org", 3: "Place"}
    typed = dict(line.split(" ::= ", 1) for line in grammar.grammar(BUSINESS, n_sentences=2, types=types).splitlines())
    assert '"HEADQUARTERED_IN E2 E" ("3")' in typed["relation"] and '"MET_WITH E' not in typed["relation"]
    inside = grammar.mentions_by_sentence(ANSWER, TEXT)
    assert inside == {1: {1, 2}, 2: {2, 3}}
    grounded = dict(line.split(" ::= ", 1) for line in grammar.grammar(BUSINESS, n_sentences=2, types=types, grounded=inside).splitlines())
    assert '"EXECUTIVE_OF E1' in grounded["relation1"] and '"EXECUTIVE_OF E1' not in grounded["relation2"]
    none = grammar.grammar(BUSINESS, n_sentences=2, types={1: "Coordinate"}).splitlines()
    assert none[0] == "root ::= entity{0,40}" and not any(line.startswith("relation") for line in none)
    flat = grammar.grammar(SPORTS, "lines")
    assert '" S" num attrs' in flat and flat.startswith("root ::= entity{0,40} relation{0,40}")


def test_answers_against_the_grammar():
    assert grammar.faults(ANSWER, BUSINESS, TEXT, grounded=True) == []
    assert grammar.typed_prefix(ANSWER)[1] == {1: "Person", 2: "Org", 3: "Place"}
    wrong = "E1 Person: Tove Brandt\nE2 Thing: x\nS2\nR EXECUTIVE_OF E1 E1 asserted\nR BORN_IN E1 E9 asserted\nS1\nR NOPE E1 E2 maybe\nE3 Org: y\nnoise"
    said = {what for _, what in grammar.faults(wrong, BUSINESS, TEXT)}
    assert said == {"unknown entity type", "both ends are one", "ends that do not fit the type", "end that is not written", "sentence out of order", "unknown relation type", "unknown modality", "entity after a sentence", "no line of an answer"}
    again = ANSWER + "\nR HEADQUARTERED_IN E2 E3 asserted\nS9\nR EXECUTIVE_OF E1 E3 asserted"
    assert {"said before", "no such sentence"} <= {what for _, what in grammar.faults(again, BUSINESS, TEXT)}
    assert (5, "end that the sentence does not name") in grammar.faults(ANSWER.replace("S1\n", "S2\n").replace("S2\nR HEAD", "R HEAD"), BUSINESS, TEXT, True)


def test_tags_and_names():
    text = "Old Nordvik Mills-\nhas mills, said Tove."
    spans = tagging.labelled_spans(text, [("Nordvik", "Org"), ("Nordvik Mills", "Org"), ("Tove", "Person")])
    assert spans == [(4, 17, "Org"), (35, 39, "Person")]
    tokens = [(0, 3), (3, 8), (8, 11), (11, 17), (17, 18), (18, 19), (19, 22), (22, 28), (28, 29), (29, 34), (34, 39), (39, 40)]
    tags = tagging.encode(text, tokens, spans)
    assert tags[1:5] == ["B-Org", "I-Org", "I-Org", "O"] and tags[10] == "B-Person"
    assert tagging.decode(text, tokens, tags) == [(4, 18, "Org"), (35, 39, "Person")]  # a hyphen belongs to the word before it
    assert tagging.decode(text, tokens, ["O"] * 3 + ["I-Org", "I-Org", "I-Org", "I-Org"] + ["O"] * 5) == [(12, 18, "Org")]  # not over the break
    assert tagging.decode(text, tokens, ["O", "O", "I-Org"] + ["O"] * 9) == [(4, 11, "Org")]  # from inside a word to its start
    assert tagging.decode("Acme, Bo", [(0, 5), (5, 8)], ["B-Org", "I-Person"]) == [(0, 4, "Org"), (6, 8, "Person")]
    assert tagging.name_mentions("Nordvik Mills", ["the mills", "Nordvik", "it", "The Mills"]) == ["Nordvik Mills", "Nordvik", "The Mills"]


def test_schema_texts_and_reduced_views():
    rendered = BUSINESS.rendered()
    assert "- HELD_AT: Event -> Place." in rendered and "- LOCATED_IN: Object|Org|Person|Place -> Place." in rendered
    shown = BUSINESS.as_json()
    assert shown["relations"]["MET_WITH"]["symmetric"] and shown["relations"]["FOUNDED"]["sources"] == ["Org", "Person"] and len(shown["entities"]) == 6
    assert ontology.following("a place; not OPERATES_IN; see LOCATED_INs; of Events", {"LOCATED_IN": "LIES_IN"}, {"OPERATES_IN", "Event"}) == "a place; see LIES_INs"
    small, named = BUSINESS.without(["HEADQUARTERED_IN"], ["Event"])
    assert "Event" not in {e.name for e in small.entities} and "HELD_AT" not in named and "PARTICIPATED_IN" not in named
    assert small.relation("LOCATED_IN").definition == "lives, is or lies there"  # its second clause names a type that is gone
    assert "FOUNDED" in ontology.coarse_rendered() and "ASSOCIATED_WITH (symmetric)" in ontology.coarse_rendered()
    assert config.first_config([None, '{"schema": "sports"}'])["format"] == "sentences"
    with pytest.raises(FileNotFoundError):
        config.first_config([None])
