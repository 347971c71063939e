import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import kernel as K
from quillspark.llm.rotacode import near_vectors, shape_for
from quillspark.llm.setsketch import _across, near_duplicates, plausible, registers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sets(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def documents(seed=1):
    r = random.Random(seed)
    docs = []
    for _ in range(40):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 20, 120, 400]))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            docs.append(" ".join(w))
    r.shuffle(docs)
    return [*docs, None, "", " \n", "one", "ONE", "a b c d", "A b\tc d", "é", "long " * 20000]


def test_near_duplicates_match_brute_force(spark):
    docs = list(enumerate(documents()))
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n long, id string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    s = {i: sets(t) for i, t in docs}
    ids = list(s)
    links = [(a, b) for a in ids for b in ids if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    want = components(ids, links)
    assert len(got) == len(docs)
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s[i]), want[i], want[i] == i)


def test_star_misses_are_found_across_components(spark):
    # 1 and 2 are alike, 2 and 0 are alike, 0 and 1 are not: the component holds all three
    base = [f"w{i}" for i in range(400)]
    edit = lambda w, at: [x if i not in at else f"e{i}" for i, x in enumerate(w)]
    near = edit(base, {50, 150, 250, 350})
    far = edit(near, {20, 120, 220, 320, 380})
    docs = [(5, " ".join(near)), (3, " ".join(base)), (4, " ".join(far))]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    s = {i: sets(t) for i, t in docs}
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    assert {r.doc_id: r.component_id for r in rows} == components(list(s), links)


def test_registers_merge_and_likelihood_keeps_links():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 63, 900).astype(np.uint64), r.integers(0, 1 << 63, 100).astype(np.uint64)
    one = registers(np.concatenate([a, b]), np.array([0, 900, 1000]), 80)
    both = registers(np.concatenate([a, b]), np.array([0, 1000]), 80)
    assert np.array_equal(both[0], one.max(axis=0))
    n = np.array([1000.0]), np.array([900.0])
    assert plausible(*n, both, one[:1], 0.85)[0]  # similarity 0.9
    assert not plausible(np.array([900.0]), np.array([900.0]), one[:1], registers(r.integers(0, 1 << 63, 900).astype(np.uint64), np.array([0, 900]), 80), 0.85)[0]


def test_near_duplicates_of_nothing(spark):
    empty = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


@pytest.mark.parametrize("chunk", [1024, 16])
def test_near_vectors_match_brute_force(spark, chunk):
    r = np.random.default_rng(2)
    rows = []
    for c in range(30):
        centre = r.standard_normal(24)
        for _ in range(r.integers(1, 9)):
            rows.append((centre + r.standard_normal(24) * 0.09, c % 3))
    centre = r.standard_normal(24)
    rows += [(centre + r.standard_normal(24) * 0.08, 1) for _ in range(70)]
    rows += [(rows[0][0], 0), (rows[0][0] * 4, 0), (rows[0][0], 1), (np.zeros(24), 0), (np.full(24, np.nan), 0), (r.standard_normal(7), 0)]
    data = [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(rows)]
    n = len(data)
    data += [(n, None, 0), (n + 1, [], 0), (n + 2, [1.0, None], 0), (n + 3, data[0][1], None)]
    got = {x.vec_id: x for x in near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), chunk=chunk).collect()}
    unit = {}
    for i, v, label in data:
        v = np.array([float("nan") if x is None else np.float32(x) for x in v or []], float)
        if label is not None and len(v) and np.isfinite(v).all() and v.any():
            unit[i] = (label, v / np.linalg.norm(v))
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98]
    want = components([i for i, *_ in data], links)
    assert len(got) == len(data) and len(links) > 1000
    for i, *_ in data:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in x for x in links), want[i], want[i] == i)


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    bits, bands = shape_for(1, 0.98, 1e-5)
    assert bits >= 10 and bands >= 1


def test_links_of_a_unit_are_fewer_than_its_rows():
    # 40 sets that are all alike, each a component of its own: every pair of them is a link
    own = [np.arange(1, 101, dtype=np.uint64)] * 40
    rows = [(i, outside) for outside in (True, False) for i in range(40)]
    unit = pa.table({"c": [i for i, _ in rows], "outside": [x for _, x in rows], "words": [K.pack_sorted(own[i]) for i, _ in rows]})
    a, b = _across(unit, 85)
    links = [(rows[i][0], rows[j][0]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(links) == 39
    assert set(components(range(40), links).values()) == {0}
