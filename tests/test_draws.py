"""Quotas, round robins and panels against plain Python."""

import hashlib
import random

import pytest

from quillspark.operators.draws import ShortDraw, dev_panel, first_of_groups, quota_draw, round_robin


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).repartition(7)


def test_first_of_groups_of_hot_null_and_small_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", None]), r.randrange(10_000), i) for i in range(6000)]
    got = {}
    for x in first_of_groups(table(spark, rows, "g string, v int, i long"), ["g"], ["v", "i"], 9).collect():
        got.setdefault(x.g, set()).add((x.v, x.i))
    for g in {x[0] for x in rows}:
        assert got[g] == set(sorted((v, i) for h, v, i in rows if h == g)[:9])
    assert first_of_groups(table(spark, rows, "g string, v int, i long").limit(0), ["g"], ["v"], 3).count() == 0
    plan = first_of_groups(table(spark, rows, "g string, v int, i long"), ["g"], ["v"], 3)._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_quota_draw_takes_distinct_prompts(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc"), f"p{r.randrange(60)}") for i in range(900)] + [(1000 + i, "z", "only") for i in range(50)]
    quotas = {"a": 20, "b": 7, "z": 1}
    drawn, counts = quota_draw(table(spark, rows, "id long, cat string, prompt string"), "cat", "prompt", "id", quotas)
    want = set()
    for cat, n in quotas.items():
        seen = {}
        for i, c, p in sorted(rows, key=lambda x: (md5(x[0]), x[0])):
            if c == cat and p not in seen and len(seen) < n:
                seen[p] = i
        want |= {(cat, i) for i in seen.values()}
    assert {(x.cat, x.id) for x in drawn.collect()} == want
    assert {tuple(x) for x in counts.collect()} == {(c, n, n, sum(1 for x in rows if x[1] == c)) for c, n in quotas.items()}
    with pytest.raises(ShortDraw, match="z: 1 of 2"):
        quota_draw(table(spark, rows, "id long, cat string, prompt string"), "cat", "prompt", "id", {"a": 3, "z": 2})
    _, short = quota_draw(table(spark, rows, "id long, cat string, prompt string"), "cat", "prompt", "id", {"none": 2}, strict=False)
    assert [tuple(x) for x in short.collect()] == [("none", 2, 0, 0)]


@pytest.mark.parametrize("count", [1, 10, 17, 120])
def test_round_robin_is_that_of_popping_in_turns(spark, count):
    rows = [(i, "abcd"[min(3, i % 9)]) for i in range(100)] + [(200 + i, "e") for i in range(20)]
    piles = {}
    for i, c in sorted(rows, key=lambda x: (md5(x[0]), x[0])):
        piles.setdefault(c, []).append(i)
    want, turn = [], 0
    while len(want) < count:
        turn += 1
        for c in sorted(piles):
            if len(want) < count and len(piles[c]) >= turn:
                want.append((c, piles[c][turn - 1], turn))
    assert sorted((x.cat, x.id, x.turn) for x in round_robin(table(spark, rows, "id long, cat string"), "cat", "id", count).collect()) == sorted(want)
    with pytest.raises(ShortDraw):
        round_robin(table(spark, rows, "id long, cat string"), "cat", "id", 121)


def plain_panel(rows, cover, n, each, preferred):
    shuffled = sorted(rows, key=lambda r: ("0" if preferred(r) else "1") + md5(r[0]))
    chosen, used = [], set()
    for tag in cover:
        for row in [r for r in shuffled if tag in r[1]][:each]:
            if row[0] not in used and len(chosen) < n:
                chosen.append(row[0])
                used.add(row[0])
    for row in shuffled:
        if row[0] not in used and len(chosen) < n:
            chosen.append(row[0])
            used.add(row[0])
    return chosen


def test_dev_panel_is_that_of_plain_python(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    tags = ["gate", "negation", "multi"]
    rows = [(f"text {i}", [t for t in tags if r.random() < 0.02 + 0.3 * (t == "multi")], i % 5) for i in range(800)] + [("text 900", ["gate", "negation", "multi"], 0)]
    df = table(spark, rows, "text string, tags array<string>, m int")
    for n in (25, 60):
        got = dev_panel(df, "text", "tags", tags, n, preferred=F.col("m") == 0)
        assert [x.text for x in got.orderBy("place").collect()] == plain_panel(rows, tags, n, 10, lambda x: x[2] == 0)
    with pytest.raises(ShortDraw, match="no rows for absent"):
        dev_panel(df, "text", "tags", ["gate", "absent"], 20)
    with pytest.raises(ShortDraw, match="801 of 802"):
        dev_panel(df, "text", "tags", ["gate"], 802)


def test_what_a_task_holds_is_bounded_by_bytes(monkeypatch):
    """60,000 rows of 5,000 letters, two of each group wanted: rows are cut long before 20,000 of them are held."""
    import pyarrow as pa

    from quillspark.operators import draws

    held = []
    cut = draws._least
    monkeypatch.setattr(draws, "_least", lambda table, *a: held.append(table.nbytes) or cut(table, *a))
    rows = lambda at: pa.RecordBatch.from_pydict({"g": [i % 3 for i in range(at, at + 500)], "o": [-i for i in range(at, at + 500)], "t": ["x" * 5000] * 500, "k": [2] * 500})
    got = pa.Table.from_batches(draws._least_of((rows(at) for at in range(0, 60_000, 500)), ["g"], ["o"], "k"))
    assert sorted(got["o"].to_pylist()) == [-59_999, -59_998, -59_997, -59_996, -59_995, -59_994]
    assert max(held) < 24 << 20
