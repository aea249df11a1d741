"""What an answer may look like: a grammar as text for constrained decoding, and a checker that reads answers line by line."""

from __future__ import annotations

import json
from collections.abc import Iterable

from . import answers
from .matching import find_all
from .prompts import MODALITIES
from .segment import numbered_sentences

MAX_NUMBER = 99


def either(values: Iterable[str]) -> str:
    return " | ".join(json.dumps(v) for v in values)


def mentions_by_sentence(answer: str, text: str) -> dict[int, set[int]]:
    """Which entity numbers have a surface that lies in a sentence, by the entity lines of an answer."""
    sentences = numbered_sentences(text)
    out: dict[int, set[int]] = {}
    for number, _, surfaces in answers.entity_lines(answer):
        spots = [spot for s in surfaces for spot in find_all(text, s)]
        for k, (a, b) in enumerate(sentences, 1):
            if any(a <= x and y <= b for x, y in spots):
                out.setdefault(k, set()).add(number)
    return out


def legal_pairs(schema, types: dict[int, str], among: set[int] | None = None) -> dict[str, list[tuple[int, list[int]]]]:
    """For each relation type, the numbers that may be its source, each with those that may be its target then."""
    numbers = [n for n in types if among is None or n in among]
    out: dict[str, list[tuple[int, list[int]]]] = {}
    for r in schema.relations:
        sources, targets = {s for s, _ in r.ends}, {t for _, t in r.ends}
        ends = [(n, [m for m in numbers if m != n and types[m] in targets]) for n in numbers if types[n] in sources]
        if own := [(n, others) for n, others in ends if others]:
            out[r.name] = own
    return out


def _relation_rule(schema, types: dict[int, str] | None, among: set[int] | None) -> str | None:
    """The ends that a relation line may have; None if there are none."""
    if types is None:
        return 'etype " E" num " E" num'
    pairs = legal_pairs(schema, types, among)
    ends = [f'"{name} E{n} E" ({either(map(str, others))})' for name, own in pairs.items() for n, others in own]
    return f"({' | '.join(ends)})" if ends else None


def grammar(schema, fmt: str = "sentences", n_sentences: int = 0, types: dict[int, str] | None = None, grounded: dict[int, set[int]] | None = None) -> str:
    """The grammar of an answer, a rule a line.

    For `sentences`, blocks stand in the order of the text's sentences. types (of the entity numbers written so far) leaves
    only relations that the schema allows between two different ones; grounded (sentence to entity numbers in it) only those within
    a sentence, and leaves out sentences without any.
    """
    keys, rules = schema.attribute_keys(), []
    entities = f"entity{{0,{answers.MAX_ENTITIES}}}"
    if fmt == "lines":
        rules += [f"root ::= {entities} relation{{0,{answers.MAX_RELATIONS}}}", 'relation ::= "R " etype " E" num " E" num " " modality " S" num attrs "\\n"']
    else:
        split = types is not None and grounded is not None
        ends = {k: _relation_rule(schema, types, grounded.get(k, set()) if split else None) for k in range(1, n_sentences + 1)}
        held = [k for k, e in ends.items() if e]
        rules.append(" ".join(["root ::=", entities, *(f"block{k}?" for k in held)]))
        rules += [f'block{k} ::= "S{k}\\n" relation{k if split else ""}{{1,{answers.MAX_BLOCK}}}' for k in held]
        bodies = {f"relation{k}": ends[k] for k in held} if split else {"relation": ends[held[0]]} if held else {}
        rules += [f'{name} ::= "R " {body} " " modality attrs "\\n"' for name, body in bodies.items()]
    rules += [
        f'entity ::= "E" num " " ntype ": " surface (" | " surface){{0,{answers.MAX_MENTIONS - 1}}} "\\n"',
        "surface ::= [^|\\n ] [^|\\n]*",
        "num ::= [1-9] [0-9]?",
        f"ntype ::= {either(e.name for e in schema.entities)}",
        f"etype ::= {either(r.name for r in schema.relations)}",
        f"modality ::= {either(MODALITIES)}",
    ]
    if keys:
        return "\n".join([*rules, 'attrs ::= "" | " " attr ("; " attr){0,3}', 'attr ::= akey "=" [^;\\n<]+', f"akey ::= {either(keys)}"])
    return "\n".join([*rules, 'attrs ::= ""'])


def faults(answer: str, schema, text: str, grounded: bool = False) -> list[tuple[int, str]]:
    """(line number, what is wrong) of an answer in `sentences`, as the typed grammar would have prevented it.

    What constrained decoding does step by step is checked here on the whole: entity lines first, blocks in order, types of the
    schema, ends that are written, legal and different, no relation twice in an answer, and the caps.
    """
    n_sentences, out = len(numbered_sentences(text)), []
    types, seen, block, size = {}, set(), 0, 0
    node_names = {e.name for e in schema.entities}
    inside = mentions_by_sentence(answer, text) if grounded else {}
    for k, line in enumerate(answer.splitlines(), 1):
        if not line.strip():
            continue
        if m := answers.ENTITY.match(line):
            number, kind = int(m[1]), m[2]
            checks = [(block, "entity after a sentence"), (kind not in node_names, "unknown entity type"), (len(types) >= answers.MAX_ENTITIES, "too many entities"), (not 1 <= number <= MAX_NUMBER, "number out of range"), (len(m[3].split("|")) > answers.MAX_MENTIONS, "too many surfaces")]
            types.setdefault(number, kind)
        elif m := answers.HEADER.match(line):
            at = int(m[1])
            checks = [(at <= block, "sentence out of order"), (at > n_sentences, "no such sentence")]
            block, size = max(block, at), 0
        elif m := answers.UNDER_HEADER.match(line):
            name, a, b, modality = m[1], int(m[2]), int(m[3]), m[4]
            size += 1
            checks = [
                (not block, "relation without a sentence"), (schema.relation(name) is None, "unknown relation type"), (modality not in MODALITIES, "unknown modality"),
                (a not in types or b not in types, "end that is not written"), (a == b, "both ends are one"), ((name, a, b) in seen, "said before"), (size > answers.MAX_BLOCK, "too many relations of a sentence"),
                (a in types and b in types and schema.relation(name) is not None and not schema.legal(name, types[a], types[b]), "ends that do not fit the type"),
                (grounded and not {a, b} <= inside.get(block, set()), "end that the sentence does not name"),
            ]
            seen.add((name, a, b))
        else:
            checks = [(True, "no line of an answer")]
        out += [(k, what) for wrong, what in checks if wrong]
    return out


def typed_prefix(answer: str) -> tuple[str, dict[int, str]]:
    """The entity lines of an answer, and the types by number: what a second, typed request starts from."""
    return answers.split_entities(answer)[0], answers.entity_numbers(answer)
