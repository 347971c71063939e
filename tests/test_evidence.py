import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.functions import evidence as E
from quillspark.operators import evidence as O
from quillspark.operators import reports as P
from quillspark.sources.contracts import parsed
from quillspark.streaming import drafts as D

EVIDENCE = [
    (("location", "Roma", "un bar a roma"), (E.USER, 9, 13, None)),
    (("location", None, "x"), (E.UNKNOWN, None, None, None)),
    (("open_now", True, "un bar aperto proprio adesso"), (E.DERIVED, None, None, "explicit_open_now_phrase")),
    (("stops", 0, "un volo diretto"), (E.DERIVED, None, None, "explicit_direct_route_phrase")),
    (("train_category", "regional", "un regionale"), (E.DERIVED, None, None, "explicit_regional_train_phrase")),
    (("arrival_time", "09:00", "entro le 9"), (E.DERIVED, 9, 10, "unique_explicit_hour_normalized_to_hh00")),
    (("arrival_time", "09:00", "entro le 9 o dopo le 8"), (E.MODEL, None, None, None)),
    (("guests", 3, "siamo in tre"), (E.DERIVED, None, None, "number_word:tre")),
    (("guests", True, "tre"), (E.MODEL, None, None, None)),
    (("location", "Lodi", "un bar"), (E.MODEL, None, None, None)),
]


@pytest.mark.parametrize("args,want", EVIDENCE)
def test_evidence(args, want):
    assert tuple(E.ground(*args)) == want


def test_trusted_sources_need_field_and_value():
    item = [{"field": "price", "value": 5, "trusted": True}]
    assert E.ground("price", 5, "x", {"price": 5}).source == E.CONTEXT
    assert E.ground("price", 5, "x", {"other": 5}, item).source == E.PROVIDER
    assert E.ground("price", 5, "x", None, [], item).source == E.CAPABILITY
    assert E.ground("cost", 5, "x", None, item).source == E.MODEL


def test_demands_and_types():
    goal = {"target": {"name": "treno"}, "facts": [], "temporal": []}
    text = "un regionale economico e diretto per arrivare entro le 9 di mattina, niente alta velocità"
    assert E.omitted(goal, text) == [code for code, *_ in E.DEMANDS]
    full = {"target": {"name": "treno regionale"}, "facts": [{"field": "stops"}, {"field": "price"}, {"field": "train_service"}], "temporal": [{"role": "arrival_time"}]}
    assert E.omitted(full, text) == []
    cases = [("fact.location", "x"), ("fact.location", " "), ("fact.open_now", True), ("fact.guests", True), ("fact.guests", 2), ("fact.price", 2.5), ("fact.price", -1), ("fact.x", "y"), ("temporal.t", "a"), ("context.party_size", 0), ("context.has_car", False), ("z", 1)]
    assert [E.typed(*c) for c in cases] == [True, False, True, False, True, True, False, False, True, False, True, False]


def contract(**goal):
    return {"schema_version": "1.3", "kind": "task", "goals": [{"id": "g1", "action": "find", "target": {"name": "treno", "type": "transport"}, "facts": [], **goal}]}


ORIGIN = {"field": "origin", "op": "eq", "value": "Lodi", "strength": "hard"}
REPAIRS = [
    (contract(), "x", "UNCHANGED", []),
    (contract(spatial=[ORIGIN]), "un treno da Lodi", "REPAIRED", ["spatial_origin_to_fact"]),
    (contract(spatial=[ORIGIN]), "un treno per Lodi", "HOLD", ["spatial_origin_not_grounded"]),
    (contract(spatial=[ORIGIN, ORIGIN]), "da Lodi", "HOLD", ["unsupported_spatial_shape"]),
    (contract(spatial=[ORIGIN], facts=[{**ORIGIN, "value": "Pavia"}]), "da Lodi", "HOLD", ["spatial_origin_conflict"]),
    (contract(spatial=[ORIGIN], extra=1), "da Lodi", "HOLD", ["repair_did_not_validate"]),
    ("{", "x", "HOLD", ["invalid_json"]),
    ([1], "x", "HOLD", ["not_object"]),
]


def test_repair(spark):
    rows = [(i, c if isinstance(c, str) else json.dumps(c), t) for i, (c, t, *_) in enumerate(REPAIRS)]
    got = O.repair(spark.createDataFrame(rows, "i int, raw string, text string").coalesce(1)).orderBy("i").collect()
    assert [(r.status, r.codes) for r in got] == [(s, c) for *_, s, c in REPAIRS]
    assert json.loads(got[1].contract)["goals"][0]["facts"] == [ORIGIN]


CAPS = {"c1": {"required": ["fact.location"], "optional": ["fact.price"], "roles": ["search_date"], "reads": True, "confirms": False, "mock": True, "binding": "mock_catalog"}, "c2": {"required": [], "optional": [], "roles": [], "reads": False, "confirms": True, "mock": True, "binding": "mock_catalog"}}


def slot(value, source=E.USER, op="eq", **more):
    return {"value": value, "operator": op, "provenance": {"source": source, "value": value}, **more}


def plan(slots, cap="c1", **more):
    base = {"execution_permitted": False, "registry_version": "3", "planner_status": "READY_FOR_DRY_RUN", "execution_plan_steps": [{"goal": "g1", "capability": cap, "mode": "DRY_RUN_ONLY", "binding": slots}], "goal_bindings": [{"goal": "g1", "capability": cap, "slots": slots}], "policy_state": [{"goal": "g1", "declared": {}}], "dependencies": [{"goal": "g1", "depends_on": [], "condition": None}]}
    return base | more


HANDOFFS = [
    (plan({"fact.location": slot("Roma")}), "READY_FOR_MOCK_DRAFT", []),
    (plan({}), "HOLD", ["required_slot_absent"]),
    (plan({"fact.location": slot("Roma", E.MODEL)}), "HOLD", ["untrusted_slot"]),
    (plan({"fact.location": slot("Roma"), "fact.price": slot(5, currency="XXX")}), "HOLD", ["currency_not_supported"]),
    (plan({"fact.location": slot(5)}), "HOLD", ["invalid_slot_type_or_operator"]),
    (plan({"fact.location": slot("Roma"), "fact.size": slot("m"), "modifiers.limit": 3}), "HOLD", ["modifier_mapping_unverified", "unmapped_slot"]),
    (plan({"fact.location": {**slot("Roma"), "value": "Lodi"}}), "HOLD", ["binding_evidence_mismatch"]),
    (plan({}, "c2"), "HOLD", ["write_or_nonmock_capability"]),
    (plan({}, "c9"), "HOLD", ["unmapped_or_mismatched_capability"]),
    (plan({}, execution_permitted=True), "HOLD", ["planner_permission_not_false"]),
    (plan({}, registry_version="2"), "HOLD", ["registry_version_mismatch"]),
    (plan({}, planner_status="NO_ACTION"), "NO_ACTION", []),
    (plan({}, reason_codes=["x"]), "HOLD", ["planner_not_ready"]),
    (plan({}, goal_bindings=[]), "HOLD", ["step_binding_count_mismatch"]),
    (plan({}, policy_state=[]), "HOLD", ["policy_or_dependency_mapping_incomplete"]),
]


def test_mock_handoff(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, *_) in enumerate(HANDOFFS)], "i int, plan string").coalesce(1)
    got = O.mock_handoff(df, CAPS, "3")
    rows = got.orderBy("i").collect()
    assert [(r.status, r.codes) for r in rows] == [(s, c) for _, s, c in HANDOFFS]
    assert json.loads(rows[0].drafts[0])["slots"]["fact.location"]["provenance"] == E.USER
    counts = {(r.kind, r.name): r.n for r in O.status_counts(got).collect()}
    assert counts[("status", "HOLD")] == 13 and counts[("code", "planner_not_ready")] == 1


def decision(operation="OPEN_DRAFT", mode="ACTIONABLE_GOAL", updates=(), **more):
    return {"protocol_version": D.PROTOCOL, "mode": mode, "operation": operation, "updates": list(updates), **more}


BOOK = {"action": "book", "target": {"name": "bar", "type": "place"}}
CAPABILITIES = [{"id": "find.place", "action": "find", "type": "place", "required": ["fact.location"]}, {"id": "book.place", "action": "book", "type": "place", "required": ["fact.guests", "fact.selection"], "confirms": True}, {"id": "find.any", "action": "monitor", "type": "*", "required": ["temporal.search_date"]}]

PROBLEMS = [
    (decision(**BOOK), None), ({}, "Invalid conversational protocol version"), (decision(mode="X"), "Unknown mode or operation"),
    (decision(mode="CHAT"), "Non-action discourse cannot create a goal"), (decision("CANCEL_DRAFT"), "Actionable mode needs a draft operation"),
    (decision(action="book"), "Opening a draft needs action and typed target"), (decision(**BOOK, updates=[{"slot": "fact.x"}]), "Invalid semantic update"),
    (decision(**BOOK, updates=[{"slot": "fact.x", "value": 1, "op": "between"}]), "Between update needs an end value"),
    (decision(**BOOK, updates=[{"slot": "x", "value": 1}]), "Unsupported slot namespace"), (decision(**BOOK, reference={"kind": "ordinal", "ordinal": 0}), "Invalid result reference"),
    (decision("UPDATE_DRAFT", additional_goals=[1]), "Additional goals require OPEN_DRAFT"), (decision(**BOOK, additional_goals=[1]), "Invalid additional goal"),
]


@pytest.mark.parametrize("case", range(len(PROBLEMS)))
def test_decisions(case):
    assert D.problem(PROBLEMS[case][0]) == PROBLEMS[case][1]


def test_a_draft_from_opening_to_contract():
    talk = D.Conversation()
    draft, note = talk.apply(decision(**BOOK, updates=[{"slot": "fact.guests", "value": 3}, {"slot": "fact.color", "value": "blu"}]), "prenota un bar in tre")
    assert not note and draft.slots["fact.guests"]["provenance"] == E.DERIVED and draft.slots["fact.color"]["tentative"]
    needs = D.requirements(draft, CAPABILITIES)
    assert (needs["ask"], needs["discover"], draft.status) == (["fact.location"], ["fact.selection"], "AWAITING_USER")
    talk.apply(decision("UPDATE_DRAFT", updates=[{"slot": "fact.location", "value": "Roma"}]), "a Roma")
    assert D.requirements(draft, CAPABILITIES)["ask"] == [] and draft.status == "DISCOVERING"
    talk.register("d1", [{"ref": "R1", "price": 9, "trusted": True}, {"ref": "R2", "price": 5, "trusted": True}])
    with pytest.raises(ValueError):
        talk.register("d1", [{"ref": "R1", "trusted": True}])
    talk.apply(decision("UPDATE_DRAFT", mode="CONTINUATION", reference={"kind": "cheapest"}), "il meno caro")
    assert draft.slots["fact.selection"]["value"] == "R2" and D.requirements(draft, CAPABILITIES)["codes"] == ["CONFIRMATION_REQUIRED"]
    talk.ask_to_confirm("d1")
    talk.apply(decision("UPDATE_DRAFT", mode="CONTINUATION", reference={"kind": "ordinal", "ordinal": 1}), "il primo")
    assert draft.confirmation == "SUPERSEDED" and draft.superseded[-1]["value"] == "R2"
    assert talk.apply(decision("CONFIRM_DRAFT", mode="CONFIRMATION"), "sì")[1].startswith("Confirmation")
    talk.ask_to_confirm("d1")
    talk.apply(decision("CONFIRM_DRAFT", mode="CONFIRMATION"), "sì")
    assert D.requirements(draft, CAPABILITIES)["ready"] and D.finished(draft)["goals"][0]["policy"] == {"confirm_before": ["book"]}
    assert talk.apply(decision("UPDATE_DRAFT", action="buy"), "x")[1] == "Action change requires an explicit new draft"
    talk.apply(decision("REJECT_DRAFT", mode="REJECTION"), "no")
    assert draft.status == "CANCELLED" and talk.apply(decision("UPDATE_DRAFT", mode="CONTINUATION"), "x")[1].startswith("Contextual reply")
    assert D.grounded("policy.forbid", "buy", "senza comprare nulla", None)["provenance"] == E.DERIVED
    assert D.grounded("temporal.search_date", "domani", "parto domani", date(2026, 2, 28))["value"] == "2026-03-01"


def test_conversations_as_a_table(spark):
    open_ = json.dumps(decision(action="monitor", target={"name": "bar", "type": "place"}))
    update = json.dumps(decision("UPDATE_DRAFT", mode="CONTINUATION", updates=[{"slot": "temporal.search_date", "value": "domani"}]))
    rows = [("a", 2, update, "domani", date(2026, 1, 1)), ("a", 1, open_, "controlla un bar", None), ("b", 1, update, "domani", None), ("c", 1, None, None, None)]
    got = {(r.conversation, r.turn): r for r in D.converse(spark.createDataFrame(rows, "conversation string, turn int, decision string, text string, day date"), CAPABILITIES).collect()}
    assert not got["a", 1].ready and got["a", 2].ready and json.loads(got["a", 2].contract)["goals"][0]["temporal"][0]["value"] == "2026-01-02"
    assert got["b", 1].note.startswith("Contextual") and got["c", 1].note.startswith("Invalid") and got["b", 1].draft is None


def test_reports(spark, tmp_path):
    good = {"label": "a", "examples": 4, "release_gates": {"mandatory_rate": 0.5, "accepted_but_wrong": 1}, "guard": {"statuses": {"ACCEPT": 3, "REPAIRED": 1}}}
    for name, text in (("a.json", json.dumps(good)), ("BEST.json", json.dumps(good)), ("bad.json", "{"), ("list.json", "[1]"), ("x.txt", "{}")):
        (tmp_path / name).write_text(text)
    (row,) = P.report_rows(P.read_reports(spark, str(tmp_path))).collect()
    assert (row.label, row.n, row.mandatory, row.acc_wrong, row.acc_prec, row.exact) == ("a", 4, 0.5, 1.0, 0.75, None)
    out = str(tmp_path / "out")
    for n in (1, 2):
        P.write_one(spark.range(n), out)
        assert spark.read.json(out).count() == n
    P.append_series(spark.range(2), str(tmp_path / "series"))
    P.append_series(spark.range(3), str(tmp_path / "series"))
    assert spark.read.option("header", True).csv(str(tmp_path / "series")).count() == 5
    c = contract(facts=[ORIGIN], depends_on=[], policy={"forbid": ["buy"]})
    df = spark.createDataFrame([(json.dumps(c), "x" * 100), ("{", "y")], "raw string, text string").withColumn("c", parsed(F.col("raw")))
    counts = {r.counter: r.n for r in P.contract_distribution(df, "text").collect()}
    assert counts["rows"] == counts["hard_facts"] == counts["prohibition"] == counts["action:find"] == counts["facts_per_goal:1"] == counts["long_input_100_chars"] == 1 and counts["dependency"] == 0
    assert [r.ok for r in spark.createDataFrame([("uno due tre quattro cinque",), ("uno due",), ("a b c d �",)], "t string").select(P.readable(F.col("t")).alias("ok")).collect()] == [True, False, False]
    tags = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, None)], "i int, tags array<string>")
    assert [r.i for r in P.tagged(tags, "tags", keep=["a"], drop=["b"]).collect()] == [1] and P.tagged(tags, "tags").count() == 3
