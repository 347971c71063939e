"""Nearest neighbours against brute force."""

import math
import random

import numpy as np

from quillspark.llm.crosspoly import axes_for, codes, hadamard, lifted, nearest, probe_order, raised, turned
from pyspark.sql import functions as F


def score(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def expected(rows, every, k):
    """Every query row's neighbours as (id, score), by brute force over the rows."""
    ok = [(at, i, [float(np.float32(x)) for x in v]) for at, (i, v) in enumerate(rows) if usable(v)]
    out = []
    for at, i, v in ok:
        if i is None or i % every:
            continue
        found = sorted((-score(v, w), j is None, j or 0, place) for place, j, w in ok if place != at and len(w) == len(v))[:k]
        out.append((i, [(None if none else j, -s) for s, none, j, _ in found]))
    return out


def table(spark, rows, more=()):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "z", 1, *more) for i, v in rows], "vec_id long, embedding array<float>, c string, row int").repartition(3)


def vectors(n, d, seed=1, spread=1.0):
    g = np.random.default_rng(seed)
    x = g.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return (x * np.exp(g.standard_normal((n, 1)) * math.log(spread))).astype(np.float32).tolist()


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(found)] for q, found in out.items()}


def test_all_candidates_of_small_and_odd_tables(spark):
    r = random.Random(4)
    rows = list(enumerate(vectors(70, 6, 2, 3.0)))
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies of one vector
    rows += [(200, None), (220, []), (240, [0.0] * 6), (260, [1.0, None, 0, 0, 0, 0]), (280, [float("nan")] * 6), (300, [float("inf"), 0, 0, 0, 0, 0])]
    rows += [(320, [1.0, 2.0]), (321, [2.0, 1.0]), (None, rows[3][1]), (None, [1.0, 3.0]), (340, [5.0, 5.0, 5.0])]
    r.shuffle(rows)
    got = answers(nearest(table(spark, rows), F.col("vec_id") % 20 == 0))
    want = dict(expected(rows, 20, 20))
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in got.items():
        assert found == want[q], q


def test_repeated_ids_are_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = sorted(tuple(r) for r in nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 3, 2, 1.0)]
    assert nearest(table(spark, rows).limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(table(spark, rows), F.lit(False)).collect() == []


def recall_of(got, want):
    hits = total = 0
    for q, found in want.items():
        mine = {i: s for i, s in got.get(q, [])}
        assert len(got.get(q, [])) == len(found)
        assert all(a[1] >= b[1] for a, b in zip(got[q], got[q][1:], strict=False))
        for i, s in found:
            total += 1
            hits += i in mine
            if i in mine:
                assert mine[i] == s
    return hits / total


def test_recall_on_directions_norms_and_a_hot_group(spark):
    for spread, seed in ((1.0, 5), (4.0, 6)):
        rows = list(enumerate(vectors(3000, 16, seed, spread)))
        g = np.random.default_rng(seed)
        centre = np.array(rows[7][1])
        rows += [(5000 + i, (centre + 0.02 * g.standard_normal(16)).astype(np.float32).tolist()) for i in range(1500)]
        got = answers(nearest(table(spark, rows), F.col("vec_id") % 20 == 0, occupancy=64, chunk=200, sample=40))
        assert recall_of(got, dict(expected(rows, 20, 20))) >= 0.9


def test_short_answers_probe_everything(spark):
    rows = list(enumerate(vectors(1200, 8, 9)))
    df = nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=400, occupancy=8, recall=0.05, tables=1)
    got, want = answers(df), dict(expected(rows, 20, 400))
    assert {len(x) for x in got.values()} == {400}
    assert set(got) == set(want)


def test_pseudo_rotations_keep_products():
    x = np.array(vectors(50, 16, 3))
    y = turned(x, 1, 0)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(y, turned(x, 0, 0))
    assert np.allclose(hadamard(np.eye(8)) @ hadamard(np.eye(8)).T, np.eye(8))


def test_lifted_angles_follow_products():
    x = np.array(vectors(40, 6, 8, 3.0))
    size = np.linalg.norm(x, axis=1)
    full = lifted(x / size[:, None], np.log2(size), np.log2(size.max()))
    q = np.array(vectors(5, 6, 9))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(full, axis=1), 1) and np.allclose(raised(q) @ full.T * size.max(), q @ x.T)


def test_probe_order_is_that_of_all_sums():
    q = raised(np.array(vectors(3, 6, 4)))
    axes = [8, 2]
    best = probe_order(q, 0, axes, 12)
    every = probe_order(q, 0, axes, 64)
    assert (every[:, :12] == best).all() and all(sorted(r) == list(range(64)) for r in every.tolist())
    assert (best[:, 0] == codes(q, 0, axes)).all()
    assert axes_for(51_282, 256, 128) == [64] and axes_for(100, 256, 128) == [] and math.prod(2 * m for m in axes_for(1 << 24, 256, 128)) == 1 << 16
