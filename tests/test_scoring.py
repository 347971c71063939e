import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import scoring as S
from quillspark.operators.matching import multiset_counts, two_pass


def test_rates_and_tags(spark):
    df = spark.createDataFrame([("a", 1, 0, 1, ["x", "x", "y"], ["e1"]), ("a", 1, 1, 0, ["x"], []), ("b", 0, 0, 0, [], ["e1", "e2", "e1"])], "g string, tp int, fp int, fn int, tags array<string>, errors array<string>")
    got = {r.g: (r.n, r.p, r.r) for r in S.rates(df, ["g"], {"p": ("tp", ["tp", "fp"]), "r": ("tp", ["tp", "fn"])}).collect()}
    assert got == {"a": (2, 0.6667, 0.6667), "b": (1, 1.0, 1.0)}
    assert S.rates(df.where("g = 'b'"), ["g"], {"p": ("tp", ["tp", "fp"])}, empty=None).first().p is None
    assert {(r.tag, r.n, r.t) for r in S.by_tag(df, "tags", F.sum("tp").alias("t")).collect()} == {("x", 2, 2), ("y", 1, 1)}
    assert [tuple(r) for r in S.taxonomy(df, "errors").collect()] == [("e1", 2), ("e2", 1)]


def test_comparisons_and_gates(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "id int, ok boolean")
    b = spark.createDataFrame([(1, False), (2, True), (3, None), (4, None)], "id int, ok boolean")
    assert {tuple(r) for r in S.paired(a, b, ["id"], "ok").collect()} == {(1, "loss"), (2, "gain"), (4, "loss")}
    assert S.complete_pairs(a.select("id"), b, "id").count() == 4
    with pytest.raises(ValueError, match="one side"):
        S.complete_pairs(a.where("id < 4"), b, "id")
    r = spark.createDataFrame([("x", 0.9, 3, 1), ("y", 0.9, 2, 2), ("z", 0.8, 0, 3)], "name string, rate double, bad int, at int")
    assert S.best(r, ["rate"], ["bad"], "name").first().name == "y"
    t = r.withColumn("tag", F.lit("t"))
    assert [tuple(x) for x in S.regressions(t, "tag", "at", "rate").collect()] == [("t", 0.9, 0.8)]
    got = {x.gate: x.verdict for x in S.gates(r.limit(1), {"rate": 0.9, "bad": 0, "none": 1}).collect()}
    assert got == {"rate": "pass", "bad": "fail", "none": "absent"}


def test_replay_verdicts(spark):
    import itertools

    from quillspark.sources.contracts import parsed

    def plain(ready, exact, label, read_only, pending):
        if label == S.RISK:
            return "FALSE_ACCEPT" if ready else "CORRECT_HOLD"
        if exact:
            return "CORRECT_ACCEPT" if ready else "FALSE_HOLD" if read_only else "CORRECT_HOLD"
        return "UNRESOLVED_GOLD" if pending else "UNRESOLVED_ONTOLOGY"

    goal = lambda action, **more: {"id": "g", "action": action, **more}
    golds = [({"kind": "task", "goals": [goal("find"), goal("compare", missing=[])]}, True), ({"kind": "task", "goals": [goal("find"), goal("book")]}, False), ({"kind": "task", "goals": [goal("find", missing=[{"field": "x"}])]}, False), ({"kind": "task", "goals": [goal("find", condition={"goal": "g"})]}, False), ({"kind": "non_actionable", "goals": []}, True)]
    cases = list(itertools.product(golds, ["READY_FOR_DRY_RUN", "NO_ACTION", "HOLD"], [True, False, None], [S.RISK, "style", None], [True, False]))
    gold = spark.createDataFrame([(i, json.dumps(c[0][0])) for i, c in enumerate(cases)], "case int, raw string").select("case", parsed(F.col("raw")).alias("c"))
    predictions = spark.createDataFrame([(i, c[1], c[2]) for i, c in enumerate(cases)], "case int, status string, exact boolean")
    review = spark.createDataFrame([(i, c[3]) for i, c in enumerate(cases) if c[3]], "case int, label string")
    flagged = spark.createDataFrame([(i,) for i, c in enumerate(cases) if c[4]], "case int")
    out = S.replay_verdicts(gold, predictions, review, flagged)
    want = {i: plain(c[1] != "HOLD", c[2], c[3], c[0][1], c[4]) for i, c in enumerate(cases)}
    assert {r.case: r.verdict for r in out.collect()} == want
    totals = S.replay_totals(out).first()
    assert totals.cases == len(cases) and totals.false_hold == sum(v == "FALSE_HOLD" for v in want.values())
    assert totals.clear_accepted == sum(v == "FALSE_ACCEPT" for v in want.values())
    with pytest.raises(ValueError, match="one side"):
        S.replay_verdicts(gold, predictions.where("case > 0"), review, flagged)


def test_matching_equals_the_greedy_loop(spark):
    import random

    r = random.Random(3)
    for _ in range(3):
        e = [(c, r.choice("ab"), r.randrange(3), i) for c in range(4) for i in range(r.randrange(6))]
        g = [(c, r.choice("ab"), r.randrange(3), i) for c in range(4) for i in range(r.randrange(6))]
        want = []
        for c in range(4):
            left, rest = [x for x in g if x[0] == c], []
            for x in (x for x in e if x[0] == c):
                hit = next((y for y in left if y[1:3] == x[1:3]), None)
                if hit:
                    left.remove(hit)
                    want.append((c, x[1], x[3], hit[3], "tp"))
                else:
                    rest.append(x)
            for x in rest:
                hit = next((y for y in left if y[1] == x[1]), None)
                if hit:
                    left.remove(hit)
                want.append((c, x[1], x[3], hit[3] if hit else None, "value_error" if hit else "fn"))
            want += [(c, y[1], None, y[3], "fp") for y in left]
        ddl = "c int, p string, v int, pos int"
        got = [(x.c, x.p, x.expected_at, x.got_at, x.kind) for x in two_pass(spark.createDataFrame(e, ddl), spark.createDataFrame(g, ddl), ["c", "p", "v"], ["c", "p"], "pos").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    counts = multiset_counts(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "c int, k string"), spark.createDataFrame([(1, "a"), (1, "c")], "c int, k string"), ["c"], ["k"]).first()
    assert (counts.tp, counts.fp, counts.fn) == (1, 1, 2)


def test_guard_tables_and_changes(spark):
    rows = [("a", "ACCEPT", True, "exact_correct"), ("a", "ACCEPT", False, "material_or_routing_risk"), ("a", "REVIEW", True, "exact_correct"), ("a", "REJECT", False, "uncertain_gold"), ("a", "ACCEPT", None, "uncertain_gold"), ("b", "REVIEW", False, "material_or_routing_risk"), ("b", None, True, None)]
    got = {r.guard: r for r in S.guard_table(spark.createDataFrame(rows, "guard string, status string, exact boolean, label string")).collect()}
    a, b = got["a"], got["b"]
    assert (a.accept, a.review, a.reject, a.coverage, a.accepted_exact_wrong, a.exact_correct_held) == (3, 1, 1, 0.6, 2, 1)
    assert (a.accepted_material_or_routing_risk, a.held_material_or_routing_risk, a.accepted_uncertain, a.held_exact_correct) == (1, 0, 1, 1)
    assert (b.accept, b.coverage, b.exact_correct_held, b.held_material_or_routing_risk) == (0, 0.0, 1, 1)
    ddl = "id int, status string, codes array<string>"
    before = spark.createDataFrame([(1, "ACCEPT", []), (2, "REVIEW", ["x"]), (3, "REVIEW", ["x"]), (4, None, None)], ddl)
    after = spark.createDataFrame([(1, "REVIEW", ["r"]), (2, "REVIEW", ["x"]), (3, "REVIEW", ["x", "y"]), (4, None, None)], ddl)
    assert {(r.id, r.before, r.after) for r in S.guard_changes(before, after, ["id"]).collect()} == {(1, "ACCEPT", "REVIEW"), (3, "REVIEW", "REVIEW")}


def test_multisets_are_counted_in_bounded_tasks(spark):
    rows = lambda items: spark.createDataFrame(items, "c int, k string")
    counts = multiset_counts(rows([(1, "a"), (1, None), (None, "x")]), rows([(1, "a"), (1, None), (None, "x")]), ["c"], ["k"], each=1)
    assert {tuple(r) for r in counts.collect()} == {(1, 1, 1, 1), (None, 0, 1, 1)}
    many = multiset_counts(rows([(i, "a") for i in range(40)]), rows([(i, "b") for i in range(40)]), ["c"], ["k"], each=5)
    assert "hashpartitioning(c#" in (plan := many._jdf.queryExecution().executedPlan().toString()) and ", 16)" in plan and "Join" not in plan
