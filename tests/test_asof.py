"""As-of joins, running values and result references against plain Python."""

import random

from quillspark.operators.asof import as_of, running_min
from quillspark.operators.references import looked_up, registered


def test_as_of_with_a_hot_key(spark):
    r = random.Random(1)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), r.randrange(2000)) for i in range(3000)] + [(9000, "only left", 1)]
    right = [(key(), at, f"v{at}") for at in r.sample(range(2000), 400)] + [("only right", 1, "x")]
    want = {}
    for i, k, at in left:
        before = [(t, v) for q, t, v in right if q == k and t < at]
        want[i] = max(before)[1] if before else None
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = as_of(spark.createDataFrame(left, "i int, k string, at int"), spark.createDataFrame(right, "k string, at int, v string"), ["k"], ["at"], ["v"])
        got = {x.i: x.found and x.found.v for x in df.collect()}
        assert got == want
        assert df.columns == ["i", "k", "at", "found"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    none = as_of(spark.createDataFrame(left[:3], "i int, k string, at int"), spark.createDataFrame([], "k string, at int, v string"), ["k"], ["at"], ["v"])
    assert [x.found for x in none.collect()] == [None] * 3


def test_running_min_with_a_hot_key(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 6 + ["a", "b"]), i, r.choice([None, r.random()])) for i in range(4000)]
    r.shuffle(rows)
    least, want = {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        seen = [x for x in (least.get(k), v) if x is not None]
        least[k] = want[i] = min(seen) if seen else None
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {x.i: x.m for x in running_min(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"], "v", "m").collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_references_to_results(spark):
    item = lambda ref, price=None, trusted=True: (ref, price, trusted)
    sets = [
        ("c", 1, [item("r1", 9.0), item("r2", 5.0), item("r3", 5.0)]),
        ("c", 4, [item("r4", 3.0), item("r1", 1.0), item("", 0.5), item("r5", 8.0, False), item("r4", 2.0)]),
        ("d", 2, [item("r1", None)]),
        ("e", 1, []),
    ]
    results = registered(spark.createDataFrame(sets, "conversation string, turn int, results array<struct<ref:string,price:double,trusted:boolean>>"))
    got = {(x.conversation, x.turn, x.ordinal): (x.ref, x.why) for x in results.collect()}
    assert got[("c", 1, 1)] == ("r1", None) and got[("c", 4, 1)] == ("r4", None)
    assert got[("c", 4, 2)] == ("r1", "duplicate_identity") and got[("c", 4, 3)] == ("", "untrusted_or_unidentified")
    assert got[("c", 4, 4)] == ("r5", "untrusted_or_unidentified") and got[("c", 4, 5)] == ("r4", "duplicate_identity")
    assert got[("d", 2, 1)] == ("r1", None)
    asked = [("c", 0, "ordinal", 1), ("c", 2, "ordinal", 3), ("c", 3, "cheapest", None), ("c", 5, "ordinal", 1), ("c", 6, "ordinal", 2), ("c", 7, "cheapest", None), ("d", 3, "cheapest", None), ("d", 4, "ordinal", 1), ("e", 2, "ordinal", 1), ("c", 8, "other", 1)]
    found = {(x.conversation, x.turn): (x.ref, x.why) for x in looked_up(spark.createDataFrame(asked, "conversation string, turn int, kind string, ordinal int"), results).collect()}
    assert found == {
        ("c", 0): (None, "no_results"), ("c", 2): ("r3", None), ("c", 3): (None, "not_uniquely_resolved"), ("c", 5): ("r4", None), ("c", 6): (None, "not_uniquely_resolved"), ("c", 7): ("r4", None),
        ("d", 3): (None, "not_uniquely_resolved"), ("d", 4): ("r1", None), ("e", 2): (None, "no_results"), ("c", 8): (None, "not_uniquely_resolved"),
    }
