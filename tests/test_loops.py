import random
import re
import time
import unicodedata

from quillspark.functions import guard as G
from quillspark.functions.requests import bare
from quillspark.functions.rowwise import dumped
from quillspark.functions.strictjson import looped
from quillspark.sources.generator import BLOCKS, made

LOOP = re.compile(r"(.{6,160}?)\1{3,}", re.S)


def test_looped_is_the_pattern():
    r, found = random.Random(4), 0
    for _ in range(3000):
        block = "".join(r.choice("ab\n") for _ in range(r.choice([1, 2, 5, 6, 7, 40, 159, 160, 161])))
        text = "".join(r.choice("ab{") for _ in range(r.randint(0, 30))) + block * r.randint(1, 6) + block[: r.randint(0, 6)] + "".join(r.choice("ab") for _ in range(r.randint(0, 30)))
        assert looped(text[-960:]) == bool(LOOP.search(text[-960:])), text
        found += looped(text[-960:])
    assert 500 < found < 2500


def test_looped_of_contracts_is_much_faster_than_the_pattern():
    raws = [dumped(x.contract) for i in range(60) for x in made(1, i, dict.fromkeys(BLOCKS, 1.0))]
    at = time.perf_counter()
    want = [bool(LOOP.search(x[-960:])) for x in raws]
    between = time.perf_counter()
    assert [looped(x[-960:]) for x in raws] == want
    assert time.perf_counter() - between < (between - at) / 3


def test_bare_and_markers():
    assert bare("Perché no") == "Perche no" and bare("abc") == "abc" and bare("") == ""
    assert G.marked("se si può, domani", G.SOFT_BARE) and G.marked("purché ci sia", G.DUTY_BARE) and not G.marked("una pizza", G.SOFT_BARE + G.DUTY_BARE)
    assert all(unicodedata.category(c) != "Mn" for m in G.SOFT_BARE for c in m)
