import json
import random
from collections import Counter

import pytest

from quillspark.functions import guard as G
from quillspark.functions.requests import BUCKETS
from quillspark.sources import generator as N
from quillspark.streaming import drafts as D


@pytest.mark.parametrize("block", sorted(N.BLOCKS))
def test_the_guard_accepts_every_block(block):
    texts = set()
    for i in range(150):
        for x in N.made(1, i, {block: 1.0}):
            v = G.check(x.contract, x.text)
            assert v.status == "ACCEPT" or block == "ambiguous", (x.text, v.findings, v.repairs)
            assert v.status in ("ACCEPT", "CLARIFY") and x.block == block
            texts.add(x.text)
    assert len(texts) >= 4


def test_contrasts_differ_in_one_operator():
    n = 0
    for i in range(400):
        x, *others = N.made(2, i)
        for y in others:
            a, b = ([(p["property"], str(p["value"])) for k in BUCKETS for p in c.contract["goals"][0][k]] for c in (x, y))
            assert sorted(a) == sorted(b) and x.text != y.text and x.family == y.family and len(others) <= 2
            n += 1
    assert n > 50


def test_wording():
    assert N.article("hotel", False) == "un " and N.article("auto", True) == "un'" and N.article("zaino", False) == "uno " and N.agreed("rosso", True) == "rossa"
    assert N.telegraphed("Trova un'auto per una persona") == "Trova auto per persona"
    r = random.Random(1)
    typo = N.mistyped("trova un portatile nuovo", r)
    assert sorted(typo) == sorted("trova un portatile nuovo") and typo != "trova un portatile nuovo"


def test_corpus_is_the_same_in_any_partitions(spark):
    a, b = (sorted(map(tuple, N.corpus(spark, 200, seed=5, partitions=p).select("id", "text", "contract").collect())) for p in (1, 7))
    assert a == b and len(a) >= 200 and all(json.loads(c)["schema_version"] == "1.1" for *_, c in a)
    blocks = Counter(r.block for r in N.corpus(spark, 300, shares={"gate": 3.0, "plain": 1.0}).collect())
    assert set(blocks) == {"gate", "plain"} and blocks["gate"] > blocks["plain"]


def test_dialogues_are_valid_and_end_ready():
    caps = [{"id": "find", "action": "find", "type": "*", "required": ["fact.location", "temporal.search_date"]}]
    ready = 0
    for i in range(60):
        talk = D.Conversation()
        for turn in N.dialogue(3, i):
            draft, note = talk.apply(turn["decision"], turn["text"])
            assert note == ""
        if draft.status != "CANCELLED":
            assert D.requirements(draft, caps)["ready"]
            ready += 1
    assert ready > 20
