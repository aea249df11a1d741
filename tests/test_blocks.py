"""Documents resolved block by block against documents resolved whole."""

import random

import pytest

from loomspan.operators import resolution

ENTITIES = "doc_id string, chunk int, ord int, ent_id string, type string, name string"
MENTIONS = "doc_id string, chunk int, ent_id string, ord int, mention string, at int"
NAMES = ["Anna Berg", "Berg", "A. Berg", "Anna", "Nordvik Mills AB", "Nordvik", "the mills", "the firm", "the company", "Acme", "Acme Group", "the group", "Group", "she", "it", "Oslo", "the city", "Oslo City", "Director Lund", "Lund", "the director", "its owner", "Mills"]


def drawn(seed, documents, chunks, per_chunk, names=NAMES):
    rng = random.Random(seed)
    entities, mentions = [], []
    for d in range(documents):
        for c in range(chunks):
            for k in range(rng.randint(0, per_chunk)):
                own = rng.sample(names, rng.randint(1, 3))
                entities.append((f"d{d}", c, k, f"e{rng.randint(1, 4)}{k}", rng.choice(["Person", "Org", "Org", "Place"]), own[0]))
                mentions += [(f"d{d}", c, entities[-1][3], i, m, rng.choice([None, rng.randint(0, 30)])) for i, m in enumerate(own)]
    return entities, mentions


@pytest.mark.parametrize("carried", [False, True])
@pytest.mark.parametrize("same_chunk", [False, True])
def test_groups_are_the_same(spark, carried, same_chunk):
    entities, mentions = drawn(5 + carried, 60, 6, 5)
    e, m = spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(mentions, MENTIONS)
    told = lambda large: {(r.doc_id, r.chunk, r.ent_id): (r.merged_id, r.merged_name, r.unnamed) for r in resolution.entity_groups(e, m, carried, same_chunk=same_chunk, large=large).collect()}
    whole = told(10**9)
    assert told(0) == whole and told(12) == whole and len(whole) == len(entities)


def test_a_document_falls_apart(spark):
    """Many different names: no block holds more than the entities that share one."""
    entities = [("d", c, 0, "e1", "Org", f"Firm{c // 2} Works") for c in range(3000)]
    mentions = [("d", c, "e1", 0, f"Firm{c // 2} Works", None) for c in range(3000)]
    e, m = spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(mentions, MENTIONS)
    from loomspan.operators.rows import written

    sizes = resolution.blocks(e, m, False, written).groupBy("block").count()
    assert sizes.agg({"count": "max"}).first()[0] == 2
    got = resolution.entity_groups(e, m, large=100)
    assert got.select("merged_id").distinct().count() == 1500
