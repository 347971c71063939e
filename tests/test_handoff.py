import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators.handoff import INTERFACE, handoff
from quillspark.sources.contracts import parsed

SPECS = [
    ("find", "find", "product", None, ["color", "price"], ["search_date"], ["sort"], ["price"], ["book"], ["price", "results_count"], ["gt"], [], True, False, True),
    ("book", "book", "place", None, ["guests"], [], [], [], ["book"], [], ["gt"], ["fact.guests"], False, False, True),
    ("media1", "play", "media", None, [], [], [], [], [], [], [], [], False, False, False),
    ("media2", "play", "media", ["song"], [], [], [], [], [], [], [], [], False, False, False),
]


def goal(i, action="find", kind="product", facts=(), name="x", **more):
    return {"id": f"g{i}", "action": action, "target": {"name": name, "type": kind}, "facts": [{"field": f, "op": "eq", **({"value_ref": v} if isinstance(v, dict) else {"value": v})} for f, v in facts], **more}


def c(*goals, kind="task", **more):
    return json.dumps({"schema_version": "1.3", "kind": kind, "goals": list(goals), **more})


CASES = {
    "ready": (c(goal(1, facts=[("color", "red")])), "READY_FOR_PLANNING", None),
    "idle": (c(kind="non_actionable"), "NO_ACTION", None),
    "none": (c(goal(1, action="rent")), "HOLD_NO_CAPABILITY", "g1:rent:product"),
    "several": (c(goal(1, action="play", kind="media", name="Song")), "HOLD_AMBIGUOUS_CAPABILITY", "g1"),
    "single": (c(goal(1, action="play", kind="media", name="film")), "READY_FOR_PLANNING", None),
    "missing": (c(goal(1, missing=[{"field": "color", "blocks": "search", "reason": "r"}])), "HOLD_MISSING_INFORMATION", "color"),
    "required": (c(goal(1, action="book", kind="place")), "HOLD_MISSING_INFORMATION", "fact.guests"),
    "fact": (c(goal(1, facts=[("size", "m")])), "HOLD_UNMAPPED_SLOT", "size"),
    "first": (c(goal(1, facts=[("size", "m")]), goal(2, action="rent")), "HOLD_UNMAPPED_SLOT", "size"),
    "role": (c(goal(1, temporal=[{"role": "action_date", "op": "eq", "value": "x"}])), "HOLD_UNMAPPED_SLOT", "action_date"),
    "sort": (c(goal(1, modifiers={"sort": {"field": "name", "direction": "asc"}})), "HOLD_UNMAPPED_SLOT", "sort"),
    "good_sort": (c(goal(1, modifiers={"sort": {"field": "price", "direction": "asc"}})), "READY_FOR_PLANNING", None),
    "limit": (c(goal(1, modifiers={"limit": 2})), "HOLD_UNMAPPED_SLOT", "limit"),
    "policy": (c(goal(1, policy={"forbid": ["buy"]})), "HOLD_UNMAPPED_SLOT", "buy"),
    "reference": (c(goal(1), goal(2, depends_on=["g1"], facts=[("price", {"goal": "g1", "field": "price"})])), "READY_FOR_PLANNING", None),
    "bad_reference": (c(goal(1), goal(2, depends_on=["g1"], facts=[("price", {"goal": "g1", "field": "name"})])), "HOLD_UNMAPPED_SLOT", "reference"),
    "ordinal": (c(goal(1), goal(2, depends_on=["g1"], facts=[("price", {"goal": "g1", "field": "price", "ordinal": 2})])), "HOLD_UNMAPPED_SLOT", "reference"),
    "forward": (c(goal(1, depends_on=["g2"]), goal(2)), "HOLD_UNMAPPED_SLOT", "depends_on"),
    "condition": (c(goal(1), goal(2, depends_on=["g1"], condition={"goal": "g1", "test": {"field": "results_count", "op": "gt", "value": 0}})), "READY_FOR_PLANNING", None),
    "bad_condition": (c(goal(1), goal(2, depends_on=["g1"], condition={"goal": "g1", "test": {"field": "results_count", "op": "lt", "value": 0}})), "HOLD_UNMAPPED_SLOT", "condition"),
    "context": (c(goal(1), context=[{"scope": "user", "field": "party_size", "op": "eq", "value": 2}]), "READY_FOR_PLANNING", None),
    "bad_context": (c(goal(1), context=[{"scope": "user", "field": "has_car", "op": "eq", "value": True}]), "HOLD_UNMAPPED_SLOT", "context.has_car"),
}


@pytest.fixture(scope="module")
def found(spark):
    cases = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "case string, raw string").select("case", parsed(F.col("raw")).alias("c")).coalesce(1).cache()
    return {r.case: r for r in handoff(cases, spark.createDataFrame(SPECS, INTERFACE), ["party_size"]).collect()}


@pytest.mark.parametrize("case", sorted(CASES))
def test_handoff(found, case):
    r = found[case]
    assert (r.status, r.detail, r.execution_permitted) == (*CASES[case][1:], False)
