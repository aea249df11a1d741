"""Settings of the engine and the fixed word lists that its rules use."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """Limits and switches. Every operator takes what it needs of these as parameters with the same defaults."""

    max_words: int = 200
    dense_words: int | None = 80
    max_mentions: int = 12
    max_entities: int = 40
    max_relations: int = 40
    block_relations: int = 24
    union_cap: int = 400
    cut: float = 0.0
    margin: float = 0.5
    retest_max: int = 4
    heading_words: int = 12
    max_known: int = 40
    max_surfaces: int = 4
    threshold: float = 0.6
    density_alpha: float = 0.5
    density_ref: float = 5.0
    tagger_words: int = 300
    carry_forward: bool = True
    carry_same_chunk: bool = False
    drop_unnamed: bool = True
    retype: bool = True


def from_json(text: str, base: EngineConfig = EngineConfig()) -> EngineConfig:
    """Settings from a JSON object: the keys that are settings here, over a base; other keys belong to the proposer and are left out."""
    names = {f.name for f in fields(EngineConfig)}
    return replace(base, **{k: v for k, v in json.loads(text).items() if k in names})


def first_config(texts: list[str | None], keys: tuple[str, ...] = ("schema", "format", "compact_prompt", "conditioned")) -> dict:
    """What a trained proposer says of how it is asked, from the first of several configurations that is there; none is an error."""
    found = next((t for t in texts if t), None)
    if found is None:
        raise FileNotFoundError("no configuration says how the proposer was trained")
    own = json.loads(found)
    defaults = {"schema": "business", "format": "sentences", "compact_prompt": False, "conditioned": False}
    return {k: own.get(k, defaults.get(k)) for k in keys}


# Word lists that results depend on.
LEGAL_SUFFIXES = frozenset("as asa ab oy aps ou gmbh ltd inc plc sa ag nv bv se llc corp co limited".split())
PRONOUNS = frozenset(
    "it he she they him her them his hers its their theirs we us our i you who which that this these those itself himself "
    "herself themselves".split()
)
ROLE_WORDS = frozenset(
    "ceo cfo coo cto chairman chairwoman chair president vice minister director head manager founder owner executive secretary "
    "governor mayor leader officer spokesman spokesperson spokeswoman chief partner member employee employer representative "
    "adviser advisor board".split()
)
FUNCTION_WORDS = frozenset("and or of for in on at to by with from but not if as is was are be the".split())
DETERMINERS = frozenset("the a an this that these those its his her their our my your".split())
GENERIC_NOUNS = frozenset(
    "company group unit area firm organisation organization corporation business brand division subsidiary parent enterprise "
    "agency institution venture city town country region state district site facility location place man woman person executive "
    "founder owner event meeting deal project team club party bank operator manufacturer supplier customer partner charity "
    "foundation trust fund authority regulator commission ministry council university institute college school hospital hospice "
    "museum festival gala fair regatta race tournament league conference summit programme program lab laboratory centre center "
    "society association federation union committee network airline insurer lender investor buyer seller mill plant studio".split()
)
SURNAME_TYPES = frozenset({"Person"})
SWAP_TYPES = ("Person", "Org", "Place")
MODALITIES = ("asserted", "negated", "hedged", "reported")
