"""Canonical forms, scores, conversions and the guard of contracts 1.1, by hand and against counting by another way."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import convert as C
from quillspark.functions import guard as G
from quillspark.functions import mentions as M
from quillspark.functions import requests as R
from quillspark.operators import requests as Q


def p(prop, op="eq", value="x", **more):
    return {"property": prop, "operator": op, "value": value, **more}


def goal(name="pizza", action="find", said="trova", attributes=(), constraints=(), preferences=(), kind="food", **more):
    return {"action": action, "raw_action": said, "target": {"name": name, "type": kind, "raw": name}, "attributes": list(attributes), "constraints": list(constraints), "preferences": list(preferences), **more}


def contract(*goals, **more):
    return {"schema_version": "1.1", "goals": list(goals), "clarification": {"required": False, "reason": None, "missing_fields": []}, **more}


def test_forms():
    assert [R.text_form(x) for x in (None, "  La  Pizza!", "in pelle", "di", "il", "a pool", "C'è", "18:00", "a|b", 5)] == ["", "pizza", "pelle", "di", "", "pool", "c e", "18:00", "a|b", "5"]
    assert [R.value_form(x) for x in (None, True, 3, "3", "-2,5", "due", "Il Rosso")] == [None, True, 3.0, 3.0, -2.5, 2.0, "rosso"]
    assert [R.currency_form(x) for x in (None, "€", "Euro", "xyz", " ")] == [None, "EUR", "EUR", "XYZ", None]
    assert [R.unit_form(x) for x in (None, "", "Notti", "GB")] == [None, None, "nights", "gb"] and R.unit_shown("gb") == "GB"
    a, b = contract(goal(attributes=[p("a"), p("b", value="due")]), goal("bar")), contract(goal("Il bar"), goal("la pizza", attributes=[p("B", value=2), p("A")]))
    assert R.contract_form(a) == R.contract_form(b) != R.contract_form(contract(goal("bar")))


def test_scores_by_hand():
    n, errors = R.score(contract(goal(attributes=[p("color", value="rosso")])), contract(goal(attributes=[p("color", value="Rosso")])))
    assert not errors and n["semantic_exact"] == 1 and n["cosmetic_exact"] == 0 and n["fact_tp"] == n["attributes_tp"] == 1
    n, errors = R.score(contract(goal(constraints=[p("price", "lt", 10, currency="EUR"), p("size")])), contract(goal(attributes=[p("price", "lte", "10", currency="euro")], constraints=[p("size", value="y"), p("brand", value="zed")])), "una pizza")
    assert errors == ["bucket:constraints->attributes", "hallucinated_fact", "operator:lt->lte", "ungrounded_value", "value_error"] or errors == sorted(errors)
    assert (n["fact_tp"], n["fact_fp"], n["fact_fn"], n["fact_value_err"], n["currency_ok"], n["hallucinated_ungrounded"]) == (1, 1, 0, 1, 1, 1)
    n, errors = R.score(contract(goal("a"), goal("b")), contract(goal("b"), goal("c"), goal("d", attributes=[p("x")])))
    # a takes the first free goal, which is b's
    assert n["target_total"] == 3 and n["target_name_ok"] == 0 and n["fact_fp"] == 1 and "extra_goal" in errors
    n, _ = R.score(contract(goal(attributes=[p("ram", value=32)])), contract(goal(attributes=[p("storage", value=32)])), "", [["storage", "ram"]])
    assert n["fact_tp"] == 1 and n["semantic_exact"] == 1
    gate = {"when": p("price", "lt", 5), "then": "buy", "otherwise": None}
    assert R.score(contract(goal(gate=gate)), contract(goal(gate={**gate, "then": "book"})))[1] == ["gate_then"]
    assert R.score(contract(goal(gate=gate)), contract(goal()))[1] == ["gate_missing"]


def test_matching_equals_greedy_search():
    r = random.Random(3)
    for _ in range(300):
        left, right = ([(r.choice("abc"), r.randint(0, 2)) for _ in range(r.randint(0, 8))] for _ in range(2))
        pairs, rest, more = R.paired([*left], [tuple(x) for x in map(list, right)], lambda x: x[0])
        free, want = list(range(len(right))), []
        for x in left:
            hit = next((i for i in free if right[i][0] == x[0]), None)
            if hit is not None:
                free.remove(hit)
                want.append((x, right[hit]))
        assert pairs == want and Counter(rest) == Counter(left) - Counter(x for x, _ in want) and Counter(more) == Counter(right[i] for i in free)


SAID = [
    ("cerco una pizza sotto i 10 euro", 10, "lt"), ("non voglio spendere più di 50 euro", 50, "lte"), ("hotel con non meno di 3 stelle", 3, "gte"),
    ("100 euro massimo", 100, "lte"), ("dieci euro per un panino proprio non li spendo", 10, "lt"), ("senza superare i 500", 500, "lt"),
    ("vorrei il Talin Max 13 pollici", 13, None), ("sotto i 300 euro e tre amplificatori", 3, None), ("se no, sotto 800 euro", 800, "lt"),
    ("almeno 3 stelle e 3 camere", 3, None), ("entro lunedì, 40 euro", 40, None), ("sarebbe il massimo con 2 camere", 2, None), ("da 6 mesi", True, None),
]


@pytest.mark.parametrize("text,value,want", SAID)
def test_comparisons(text, value, want):
    assert M.strictness(text, value) == want


def test_mentions():
    assert [M.number_role(t, 20) for t in ("un tavolo alle 20", "20 euro", "a 20 km", "per 20 persone", "20 stelle", "20 notti", "20", "alle 20 per 20 persone")] == ["time", "money", "distance", "quantity", "rating", "duration", None, None]
    assert [M.negated(t, "rosso") for t in ("zorba no rosso", "zorba rosso", "niente di rosso", "no blu, rosso", "no rosso o rosso", "senza cipolla rosso")] == [True, False, True, False, False, False]
    full = contract(goal(constraints=[p("ingredient", "excludes", "cipolla"), p("date", value="sabato"), p("location", value="Roma"), p("guests", value=2), p("price", value=10)]))
    text = "Trova una pizza senza cipolla sabato a Roma per due persone a 10 euro"
    assert M.left_out(full, text) == [] and [k for k, _ in M.left_out(contract(goal()), text)] == ["exclusion", "day", "name", "number", "quantity"]
    assert M.left_out(contract(goal()), "una pizza senza superare niente, senza problemi") == []
    assert [R.is_said(v, "due panini rossi alle 20:30 dal sito") for v in (2, "panino", "rossa", "20:30", "20:00", 30.0, "blu", "rosso|blu", True, None, "", "5")] == [True, True, True, True, True, True, False, False, True, True, True, False]
    assert R.action_said("trovami", "trova un bar") and not R.action_said("compra", "trova un bar") and R.action_said("(implicito)", "x")


def g(**k):
    return contract(goal(**k))


GUARD = [
    (g(), "trova una pizza", "ACCEPT", []),
    (g(attributes=[p("price", "lte", "10", currency="euro")]), "trova una pizza massimo 10 euro", "REPAIRED", []),
    (g(attributes=[p("ingredient", "contains", "non cipolla")]), "trova una pizza senza cipolla", "REPAIRED", []),
    (g(constraints=[p("price", "eq", 10, currency="EUR")]), "trova una pizza sotto i 10 euro", "CLARIFY", ["operator_strictness_mismatch"]),
    (g(attributes=[p("color", value="rosso")]), "trova una pizza no rosso", "CLARIFY", ["operator_polarity_mismatch"]),
    (g(name="sushi"), "trova una pizza", "CLARIFY", ["hallucinated_target"]),
    (g(attributes=[p("guests", value=20)]), "trova una pizza alle 20", "CLARIFY", ["number_role_mismatch"]),
    (g(attributes=[p("feature", value="senti")]), "senti, trova una pizza", "CLARIFY", ["filler_as_value"]),
    (g(said="compra"), "trova una pizza", "CLARIFY", ["hallucinated_raw_action"]),
    (g(name="la"), "trova la pizza", "REJECT", ["empty_target"]),
    (g(constraints=[p("price", "lte", 10, currency="USD")]), "trova una pizza massimo 10 euro", "CLARIFY", ["hallucinated_currency"]),
    (g(attributes=[p("color", value="blu")]), "trova una pizza", "CLARIFY", ["hallucinated_value"]),
    (g(constraints=[p("price", "lt", 5, currency="EUR"), p("price", "gt", 9, currency="EUR")]), "trova una pizza tra 5 e 9 euro", "CLARIFY", ["conflicting_predicates"]),
    (g(constraints=[p("price", "between", 5, currency="EUR")]), "trova una pizza da 5 euro", "CLARIFY", ["between_without_value_to"]),
    (g(), "trova una pizza sabato", "CLARIFY", ["unaccounted_fact"]),
    (g(action="buy", gate={"when": p("price", "lt", 5, currency="EUR"), "then": "notify", "otherwise": None}), "trova una pizza, e se costa meno di 5 euro avvisami", "CLARIFY", ["gate_on_non_observational"]),
    ({**g(), "clarification": {"required": True, "reason": None, "missing_fields": []}}, "trova una pizza", "CLARIFY", ["clarification_without_fields", "clarification_without_reason"]),
    ({**g(), "clarification": {"required": False, "reason": "x", "missing_fields": []}}, "trova una pizza", "REPAIRED", []),
    ({**g(), "schema_version": "1.0"}, "trova una pizza", "REPAIRED", []),
    ({"goals": []}, "x", "REJECT", ["schema_violation"]),
    (g(attributes=[p("color", value="rosso"), p("color", value="Rosso")], constraints=[p("color", "neq", "rosso")]), "trova una pizza rosso", "REPAIRED", []),
]


@pytest.mark.parametrize("case", range(len(GUARD)))
def test_guard(case):
    c, text, status, codes = GUARD[case]
    v = G.check(c, text)
    assert (v.status, sorted({f.code for f in v.findings if f.severity == "error"})) == (status, codes)
    assert (v.contract is None) == (status in ("CLARIFY", "REJECT"))
    if status == "REPAIRED":
        again = G.check(v.contract, text)
        assert again.status == "ACCEPT" and again.contract == v.contract


def test_guard_moves_facts_and_asks(spark):
    v = G.check(GUARD[1][0], GUARD[1][1]).contract["goals"][0]
    assert v["attributes"] == [] and v["constraints"] == [p("price", "lte", 10, currency="EUR")]
    ask = G.question("trova una pizza blu", "target_missing", [], g(name="sushi"))
    assert ask["goals"][0]["raw_action"] == "trova" and ask["goals"][0]["target"]["name"] == "unknown" and ask["clarification"]["missing_fields"] == ["goal"]
    rows = spark.createDataFrame([(json.dumps(c), t) for c, t, *_ in GUARD] + [("{", "x"), (None, None)], "raw string, text string").coalesce(1)
    got = rows.select(Q.guard_11(F.col("raw"), F.col("text")).alias("v")).select("v.*").collect()
    assert [(x.status, x.codes) for x in got[: len(GUARD)]] == [(s, k) for _, _, s, k in GUARD]
    assert [x.codes for x in got[len(GUARD) :]] == [["extraction:truncated"], ["extraction:empty"]]


def fact(field, op="eq", value="x", strength="hard", **more):
    return {"field": field, "op": op, "value": value, "strength": strength, **more}


def new(i=1, action="find", name="bar", kind="place", facts=(), **more):
    return {"id": f"g{i}", "action": action, "target": {"name": name, "type": kind}, "facts": list(facts), **more}


def whole(*goals, version="1.2", **more):
    return {"schema_version": version, "kind": "task", "goals": list(goals), **more}


def frame(spark, rows, columns):
    return spark.createDataFrame([tuple(json.dumps(x) if isinstance(x, (dict, list)) else x for x in r) for r in rows], columns).coalesce(1)


def test_conversions(spark):
    rows = [
        ("plain", whole(new(facts=[fact("color")]))),
        ("times", whole(new(kind="transport", name="treno", facts=[fact("arrival_time", "before", "9:00"), fact("date", value="domani")]))),
        ("vague", whole(new(kind="transport", name="treno", facts=[fact("time", "before", "9:00")]))),
        ("counts", whole(new(action="compare", kind="product", facts=[fact("quantity", value=3)], ranking={"field": "price", "direction": "asc"}))),
        ("owner", whole(new(), context=[{"field": "mood", "op": "eq", "value": "x"}])),
        ("user", whole(new(), context=[{"field": "has_car", "op": "eq", "value": False}])),
        ("held", whole(new(action="contact", kind="person"))),
        ("bad", whole(new(facts=[fact("price", "lte", 3)]))),
        ("new", whole(new(), version="1.3")),
        ("bad_new", whole(version="1.3")),
        ("other", whole(version="9")),
        ("list", [1]),
    ]
    got = {r.case: r for r in Q.project(frame(spark, rows, "case string, raw string")).collect()}
    holds = {k: r.hold for k, r in got.items() if r.hold}
    assert holds == {"vague": "v12_projection_hold:transport time lacks arrival/departure role", "owner": "v12_projection_hold:unknown context owner: mood", "held": "v12_projection_hold:projection held: missing_required_information", "bad": "v12_projection_hold:source is not a valid contract 1.2", "bad_new": "v13_invalid:task_without_goal", "other": "unsupported_version", "list": "not_object"}
    made = {k: json.loads(r.contract) for k, r in got.items() if r.contract}
    assert {t["role"] for t in made["times"]["goals"][0]["temporal"]} == {"arrival_time", "search_date"}
    assert made["counts"]["goals"][0]["modifiers"] == {"sort": {"field": "price", "direction": "asc"}, "compare_count": 3} and made["counts"]["goals"][0]["facts"] == []
    assert made["user"]["context"] == [{"scope": "user", "field": "has_car", "op": "eq", "value": False}] and made["new"] == whole(new(), version="1.3")
    old = [
        (g(attributes=[p("color", value="rosso")], preferences=[p("brand", value="zed")]), "trova una pizza rosso possibilmente zed"),
        (contract(goal(), goal()), "trova una pizza"),
        (g(action="buy", said="compra"), "compra una pizza"),
        (g(kind=None), "trova una pizza"),
        (g(attributes=[p("color", value="blu")]), "trova una pizza"),
        (g(constraints=[p("distance", "lte", 5)]), "trova una pizza entro 5 km"),
    ]
    got = Q.convert(frame(spark, old, "raw string, text string")).collect()
    assert [r.reasons for r in got] == [[], ["multi_goal_requires_review"], ["side_effect_or_nonfind_action_requires_review"], ["target_type_unknown"], ["source_guard_clarify"], ["v12_unit_missing"]]
    assert [f["strength"] for f in json.loads(got[0].contract)["goals"][0]["facts"]] == ["hard", "soft"]
    assert Q.convertible(frame(spark, old, "raw string, text string")).count() == 1
    assert C.tags(contract(goal(attributes=[p("a"), p("b")], preferences=[p("c", "neq")], said="(implicito)"), goal())) == ["implicit-action", "multi-goal", "negation", "preference", "three-plus-facts"]
    updates = C.slot_updates(new(facts=[fact("a", "between", 1, value_to=2)], policy={"forbid": ["buy"]}, modifiers={"limit": 2, "sort": {}}), [{"field": "has_car", "value": True}])
    assert [u["slot"] for u in updates] == ["fact.a", "modifier.limit", "external.has_car", "policy.forbid"]
    assert C.slot_set(updates)[0] == ("external.has_car", "eq", "true")


def test_scores_12_and_13(spark):
    a = whole(new(1, facts=[fact("color", value="Rosso"), fact("price", "lte", 9, "soft", currency="EUR")]), new(2, "book", facts=[{"field": "x", "op": "eq", "value_ref": {"goal": "g1", "field": "result"}, "strength": "hard"}], depends_on=["g1"]))
    renamed = whole(new(7, facts=[fact("price", "lte", 9, "soft", currency="EUR"), fact("color", value=" rosso")]), new(9, "book", facts=[{"field": "x", "op": "eq", "value_ref": {"goal": "g7", "field": "result"}, "strength": "hard"}], depends_on=["g7"]))
    assert C.canonical_12(a) == C.canonical_12({**renamed, "goals": renamed["goals"][::-1]})
    rows = [
        ("same", a, renamed), ("strength", a, whole(new(1, facts=[fact("color", value="rosso"), fact("price", "lte", 9, "hard", currency="EUR")]))),
        ("invalid", a, whole(new(facts=[fact("price", "lte", 9)]))), ("none", a, None), ("list", a, [1]),
    ]
    scored = Q.score_12(frame(spark, rows, "case string, expected string, got string"))
    got = {r.case: r for r in scored.collect()}
    assert got["same"].complete_success == 1 and got["same"].facts_tp == 3 and got["same"].references_tp == got["same"].dependencies_tp == 1
    s = got["strength"]
    assert (s.facts_tp, s.facts_fp, s.facts_fn, s.hard_tp, s.hard_fp, s.soft_fn, s.action_correct, s.goals, s.goal_count_correct) == (1, 1, 2, 1, 1, 1, 0, 2, 0)  # book comes before find
    assert [got[k].issues for k in ("invalid", "none", "list")] == [["currency_missing"], ["not_object"], ["not_object"]] and got["invalid"].facts_tp is None
    rates = Q.rates_12(scored).collect()[0]
    assert (rates.n, rates.schema_valid_rate, rates.complete_success_rate, rates.context_recall) == (5, 0.4, 0.2, None)
    assert rates.facts_precision == pytest.approx(4 / 5, abs=1e-6) and rates.action_accuracy == pytest.approx(2 / 4)
    b = whole(new(facts=[fact("color", value="Rosso"), fact("ram", value="8")], temporal=[{"role": "search_time", "op": "eq", "value": "9:00", "strength": "hard"}]), version="1.3")
    c = whole(new(name="BAR", facts=[fact("ram", value="8"), fact("color", value="rosso")], temporal=[{"role": "search_time", "op": "eq", "value": "09:00", "strength": "hard"}]), version="1.3")
    b["goals"][0]["facts"][1] = c["goals"][0]["facts"][0] = fact("brand", value="zed")
    rows = [("near", b, c, "x"), ("self", b, b, "x"), ("held", b, whole(new(facts=[fact("mood")]), version="1.3"), "siamo in 4"), ("broken", b, "{", "x"), ("gold", [1], b, "x")]
    scored = Q.score_13(frame(spark, rows, "case string, expected string, got string, text string"))
    got = {r.case: r for r in scored.collect()}
    n = got["near"]
    assert (n.literal_equal, n.canonical_equal, n.fact_tp, n.fact_gold, n.temporal_tp, n.target_correct, n.guard_accept, n.invariant_valid) == (0, 1, 1, 2, 0, 0, 1, 1)
    assert got["self"].literal_equal == 1 and got["self"].modifier_correct == got["self"].missing_correct == 1
    assert got["held"].guard_codes == ["missing_user_context"] and got["broken"].guard_status == "REJECT_INVALID" and not got["gold"].eligible
    rates = Q.rates_13(scored).collect()[0]
    assert (rates.n, rates.canonical_exact, rates.guard_coverage, rates.fact_recall) == (4, 0.5, 0.5, 0.375)
    flags = {r.case: (r.literal_equal, r.canonical_equal, r.presence_equal, r.valid) for r in Q.compared(frame(spark, [("a", b, c), ("b", b, {**b, "context": []}), ("c", b, [1])], "case string, expected string, got string")).collect()}
    assert flags == {"a": (False, True, True, True), "b": (False, False, True, True), "c": (False, False, False, False)}


def test_score_columns_and_rates(spark):
    rows = [(contract(goal(attributes=[p("ram", value=32)])), contract(goal(attributes=[p("storage", value=32)])), "x", [["ram", "storage"]]), (contract(goal()), contract(goal("bar")), "x", None), (contract(goal()), "{", "x", None)]
    df = frame(spark, [(json.dumps(a), json.dumps(b) if isinstance(b, dict) else b, t, None) for a, b, t, _ in rows], "expected string, got string, text string, none string")
    df = df.withColumn("equivalences", F.when(F.col("expected").contains("ram"), F.array(F.array(F.lit("ram"), F.lit("storage")))))
    scored = df.select(Q.score_11(F.col("expected"), F.col("got"), F.col("text"), F.col("equivalences")).alias("s")).select("s.*").where("errors is not null")
    assert [r.errors for r in scored.collect()] == [[], ["target_name"]]
    r = Q.rates_11(scored).collect()[0]
    assert (r.n, r.semantic_exact_rate, r.target_name_accuracy, r.fact_precision, r.unit_accuracy) == (2, 0.5, 0.5, 1.0, 1.0)
    assert {x.bucket: (x.tp, x.precision) for x in Q.bucket_rates(scored).collect()} == {"attributes": (1, 1.0), "constraints": (0, 1.0), "preferences": (0, 1.0)}
    alarms = Q.guard_false_alarms(frame(spark, [(json.dumps(c), t) for c, t, *_ in GUARD[:3]], "raw string, text string")).collect()
    assert [a.status for a in alarms] == ["REPAIRED", "REPAIRED"]
    files = frame(spark, [("a", g()), ("a", {"schema_version": "1.1"}), ("b", whole(new()))], "file string, raw string")
    assert {(r.file, r.ok, r.failed) for r in Q.schema_totals(files).collect()} == {("a", 1, 1), ("b", 1, 0)}
