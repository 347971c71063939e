"""Each guard's codes, one request for one code, and what the chain makes of them."""

import json

import pytest

from quillspark.operators.guards import guard_12, guard_13


def fact(field, op="eq", value="x", **more):
    return {"field": field, "op": op, "value": value, "strength": "hard", **more}


def ref(goal, field="result", **more):
    return {"field": "selection", "op": "eq", "value_ref": {"goal": goal, "field": field, **more}, "strength": "hard"}


def goal(i=1, action="find", kind="place", name="bar", facts=(), **more):
    target = {"name": name, **({"type": kind} if kind else {})}
    return {"id": f"g{i}", "action": action, "target": target, "facts": list(facts), **more}


def contract(*goals, version="1.3", kind="task", **more):
    return {"schema_version": version, "kind": kind, "goals": list(goals), **more}


def old(*goals, **more):
    return contract(*goals, version="1.2", **more)


def time(role, value, op="eq"):
    return {"role": role, "op": op, "value": value, "strength": "hard"}


MESSAGE = fact("message", value="ciao")
WHEN = [time("action_date", "domani"), time("action_time", "20:00")]
FORBID = {"policy": {"forbid": ["book"]}}

FIRST = {  # contracts 1.2: text, status, codes of the first guard
    "clean": (old(goal()), "trova un bar", "ACCEPT", []),
    "broken": ("{", "x", "REJECT", ["invalid_json"]),
    "list": ("[1]", "x", "REJECT", ["not_object"]),
    "extra": ({**old(goal()), "x": 1}, "x", "REJECT", ["schema:schema"]),
    "empty": (old(), "x", "REJECT", ["schema:task_without_goal"]),
    "missing": (old(goal(missing=[{"field": "date", "blocks": "search", "reason": "unspecified"}])), "x", "REVIEW", ["declared_missing_input"]),
    "pending": (old(goal(action="book", name="treno", policy={"confirm_before": ["book"]})), "x", "REVIEW", ["explicit_confirmation_pending"]),
    "table": (old(goal(action="book", name="una Trattoria", facts=[fact("date")])), "x", "REVIEW", ["table_booking_requires_details"]),
    "flight": (old(goal(action="book", name="volo", facts=[fact("date")])), "x", "REVIEW", ["flight_booking_requires_details"]),
    "contact": (old(goal(action="contact", kind="person")), "x", "REVIEW", ["contact_requires_message"]),
    "negative": (old(goal(facts=[fact("price", "lte", -3, currency="EUR")])), "x", "REJECT", ["negative_money_value"]),
    "zero": (old(goal(facts=[fact("price", "lte", 0, currency="EUR")])), "x", "REJECT", ["nonpositive_price_ceiling"]),
    "condition": (old(goal(), goal(2, depends_on=["g1"], condition={"goal": "g1", "test": {"field": "x", "op": "eq", "value": 1}})), "fallo", "REVIEW", ["ungrounded_condition"]),
    "grounded": (old(goal(), goal(2, depends_on=["g1"], condition={"goal": "g1", "test": {"field": "x", "op": "eq", "value": 1}})), "se trovi", "ACCEPT", []),
    "fallback": (old(goal()), "e se non ne trovi un altro", "REVIEW", ["possible_missing_fallback_goal"]),
    "followup": (old(goal()), "trova un bar, poi prenota", "REVIEW", ["possible_missing_followup_goal"]),
    "ranking": (old(goal()), "il più economico", "REVIEW", ["missing_price_ranking"]),
    "ranked": (old(goal(ranking={"field": "price", "direction": "asc"})), "il più economico", "ACCEPT", []),
    "no_book": (old(goal()), "senza prenotare", "REVIEW", ["missing_explicit_booking_prohibition"]),
    "no_buy": (old(goal(**FORBID)), "non comprare, non prenotare", "REVIEW", ["missing_explicit_purchase_prohibition"]),
    "confirm": (old(goal()), "solo se confermo", "REVIEW", ["missing_explicit_confirmation"]),
    "reminder": (old(goal(action="notify", kind="reminder")), "ricordamelo", "REVIEW", ["unresolved_reminder_reference"]),
    "context": (old(goal()), "siamo in tre", "REVIEW", ["possible_missing_user_context"]),
}
ROUTED = {
    "clean": (old(goal()), "trova un bar", "ACCEPT", []),
    "notify": (old(goal(action="notify", kind="product", name="x")), "avvisami", "REVIEW", ["notify_message_unresolved", "notify_target_not_reminder"]),
    "visit": (old(goal(action="cancel", kind="place", name="la visita")), "annulla", "REVIEW", ["appointment_routing_mismatch"]),
    "scooter": (old(goal(action="rent", kind="product", name="scooter")), "x", "REVIEW", ["vehicle_routing_mismatch"]),
    "dentist": (old(goal(kind="person", name="Dentista")), "x", "REVIEW", ["professional_routing_mismatch"]),
    "compare": (old(goal(action="compare", kind="product")), "confrontami tre bar", "REVIEW", ["comparison_quantity_missing"]),
    "compared": (old(goal(action="compare", kind="product", facts=[fact("quantity", value=3)])), "confrontami 3 bar", "ACCEPT", []),
    "train": (old(goal(kind="transport", name="treno", facts=[fact("time", "before", "9:00")])), "treno che arriva alle 9", "REVIEW", ["arrival_time_field_missing", "transport_time_role_ambiguous"]),
    "leaves": (old(goal(kind="transport", name="treno")), "un treno che parta alle 9", "REVIEW", ["departure_time_field_missing"]),
}
NEW = {  # contracts 1.3 (and 1.2): text, status, codes of the whole chain
    "clean": (contract(goal()), "trova un bar", "ACCEPT", []),
    "broken": ("nope", "x", "REJECT_INVALID", ["invalid_json"]),
    "scalar": ("5", "x", "REJECT_INVALID", ["not_object"]),
    "version": (contract(goal(), version="7"), "x", "REJECT_INVALID", ["unsupported_version"]),
    "schema": (contract(goal(kind="spaceship")), "x", "REJECT_INVALID", ["schema"]),
    "old_schema": (old({**goal(), "id": "x"}), "x", "REJECT_INVALID", ["schema_or_v12:schema"]),
    "old_rule": (old(goal(facts=[fact("price", "lte", 3)])), "x", "REJECT_INVALID", ["schema_or_v12:currency_missing"]),
    "old_review": (old(goal()), "il più economico", "HOLD_NEEDS_CLARIFICATION", ["missing_price_ranking"]),
    "old_routed": (old(goal(kind="person", name="dentista")), "x", "HOLD_NEEDS_CLARIFICATION", ["professional_routing_mismatch"]),
    "old_negative": (old(goal(facts=[fact("price", "lte", -1, currency="EUR")])), "x", "REJECT_INVALID", ["negative_money_value"]),
    "models": (contract(goal(facts=[fact("model", value="a"), fact("model", value="b")])), "x", "HOLD_SEMANTIC_CONFLICT", ["conflicting_hard_equality"]),
    "policy": (contract(goal(action="book", kind="ticket", policy={"confirm_before": ["buy"]})), "x", "HOLD_POLICY_MISMATCH", ["policy_action_mismatch"]),
    "details": (contract(goal(action="contact", kind="person")), "x", "HOLD_MISSING_REQUIRED_INFORMATION", ["missing_required_information"]),
    "hire": (contract(goal(action="hire", kind="food")), "x", "HOLD_UNSUPPORTED_ACTION", ["unsupported_action_target"]),
    "unit": (contract(goal(facts=[fact("distance", "lte", 3)])), "x", "HOLD_NEEDS_CLARIFICATION", ["unit_missing"]),
    "counted": (contract(goal(action="compare", kind="product")), "compara tre cose", "HOLD_MISSING_REQUIRED_INFORMATION", ["cardinality_lost"]),
    "moved": (contract(goal(action="reschedule", kind="appointment", facts=[fact("booking_id")])), "x", "HOLD_UNSUPPORTED_ACTION", ["reschedule_provider_not_verified"]),
    "sorted": (contract(goal(action="order", kind="food")), "ordinami i bar per prezzo", "HOLD_UNSUPPORTED_ACTION", ["sort_misread_as_order"]),
    "rental": (contract(goal(kind="vehicle", name="moto")), "noleggia una moto", "HOLD_UNSUPPORTED_ACTION", ["rental_misread_as_find"]),
    "unbound": (contract(goal(action="buy", kind="ticket")), "compra ma chiedimi conferma", "HOLD_POLICY_MISMATCH", ["confirmation_not_bound_to_action", "explicit_confirmation_missing_v3"]),
    "party": (contract(goal()), "siamo in 4", "HOLD_NEEDS_CLARIFICATION", ["missing_user_context"]),
    "party_told": (contract(goal(), context=[{"scope": "user", "field": "party_size", "op": "eq", "value": 4}]), "siamo in 4", "ACCEPT", []),
    "field": (contract(goal(facts=[fact("mood")])), "x", "HOLD_UNSUPPORTED_ACTION", ["unknown_planner_field"]),
    "alias": (contract(goal(facts=[fact("delivery")])), "x", "HOLD_UNSUPPORTED_ACTION", ["alias_requires_planner_mapping"]),
    "direct": (contract(goal(kind="transport", name="volo")), "un volo diretto", "HOLD_MISSING_REQUIRED_INFORMATION", ["direct_flight_constraint_missing"]),
    "direct_told": (contract(goal(kind="transport", name="volo", facts=[fact("stops", value=0)])), "un volo diretto", "ACCEPT", []),
    "no_book": (contract(goal(kind="accommodation", name="hotel")), "trova un hotel, non prenotarne", "HOLD_POLICY_MISMATCH", ["explicit_no_book_policy_missing_v5", "explicit_no_booking_policy_missing"]),
    "quoted": (contract(goal()), "sto scrivendo una scena: un personaggio dice trova un bar", "HOLD_SEMANTIC_CONFLICT", ["quoted_command_misread_as_action"]),
    "shown": (contract(goal()), "mostrami soltanto tre bar", "HOLD_MISSING_REQUIRED_INFORMATION", ["result_limit_missing", "result_limit_missing_v2"]),
    "then": (contract(goal(), goal(2, action="book", kind="ticket")), "cerca un bar e poi prenota", "HOLD_UNSUPPORTED_ACTION", ["booking_result_dependency_missing", "booking_result_dependency_missing_v2"]),
    "then_bound": (contract(goal(), goal(2, action="book", kind="ticket", depends_on=["g1"], facts=[ref("g1", ordinal=1)])), "cerca un bar e poi prenota", "ACCEPT", []),
    "then_lost": (contract(goal()), "cerca un bar e poi prenota", "HOLD_MISSING_REQUIRED_INFORMATION", ["requested_booking_goal_missing", "requested_booking_goal_missing_v2"]),
    "example": (contract(goal()), "esempio di comando: trova un bar. spiega", "HOLD_SEMANTIC_CONFLICT", ["quoted_example_misread_as_action"]),
    "arrive": (contract(goal(kind="transport", name="treno")), "treno per arrivare entro le 14", "HOLD_MISSING_REQUIRED_INFORMATION", ["arrival_deadline_role_missing"]),
    "origin": (contract(goal(kind="transport", name="treno")), "parto da Lodi", "HOLD_MISSING_REQUIRED_INFORMATION", ["explicit_origin_missing"]),
    "walk": (contract(goal()), "un bar raggiungibile a piedi", "HOLD_MISSING_REQUIRED_INFORMATION", ["walking_access_missing"]),
    "walk_told": (contract(goal(facts=[fact("access", value="a piedi"), fact("open_now", value=True)])), "un bar aperto ora raggiungibile a piedi", "ACCEPT", []),
    "open": (contract(goal(facts=[fact("open_now", value="true")])), "un bar aperto adesso", "HOLD_MISSING_REQUIRED_INFORMATION", ["open_now_missing"]),
    "restaurant": (contract(goal(action="book", name="ristorante", temporal=WHEN)), "x", "HOLD_MISSING_REQUIRED_INFORMATION", ["restaurant_booking_slots_missing"]),
    "restaurant_told": (contract(goal(action="book", name="ristorante", temporal=WHEN, facts=[fact("guests", value=2)])), "x", "ACCEPT", []),
    "none_found": (contract(goal()), "solo in assenza di risultati", "HOLD_UNSUPPORTED_ACTION", ["zero_results_fallback_missing"]),
    "none_told": (contract(goal(), goal(2, depends_on=["g1"], condition={"goal": "g1", "test": {"field": "results_count", "op": "eq", "value": 0}})), "solo in assenza di risultati", "ACCEPT", []),
    "purchase": (contract(goal(kind="food", name="pizza", policy={"forbid": ["buy"]})), "niente acquisti", "HOLD_POLICY_MISMATCH", ["explicit_no_purchase_policy_missing_v3"]),
    "purchase_told": (contract(goal(kind="food", name="pizza", policy={"forbid": ["buy", "order"]})), "niente acquisti", "ACCEPT", []),
    "plumber": (contract(goal(action="hire", kind="professional_service", name="idraulico")), "assumi", "HOLD_MISSING_REQUIRED_INFORMATION", ["provider_identity_missing_v3"]),
    "hour": (contract(goal(action="notify", kind="reminder", facts=[MESSAGE], temporal=[time("notification_time", "09:30")])), "domani alle 9:00 ricordami di uscire", "HOLD_MISSING_REQUIRED_INFORMATION", ["explicit_reminder_time_mismatch_v3"]),
    "hour_told": (contract(goal(action="notify", kind="reminder", facts=[MESSAGE], temporal=[time("notification_time", "09:00")])), "domani alle 9 ricordami di uscire 'alle 10'", "ACCEPT", []),
    "approval": (contract(goal(action="buy", kind="ticket")), "compra solo dopo il mio sì", "HOLD_POLICY_MISMATCH", ["explicit_approval_missing_v4"]),
    "compare4": (contract(goal(action="compare", kind="product", modifiers={"compare_count": 2})), "paragona tre cose", "HOLD_MISSING_REQUIRED_INFORMATION", ["compare_count_missing_v4"]),
    "cheap": (contract(goal(action="compare", kind="product")), "dal meno caro al più caro", "HOLD_MISSING_REQUIRED_INFORMATION", ["explicit_price_sort_missing_v4"]),
    "rail": (contract(goal(kind="transport", name="mezzo")), "un regionale", "HOLD_MISSING_REQUIRED_INFORMATION", ["rail_mode_not_bound_to_target_v4"]),
    "second": (contract(goal(), goal(2, action="contact", kind="person", depends_on=["g1"], facts=[MESSAGE, ref("g1", ordinal=1)])), "trova bar e contatta il secondo", "HOLD_MISSING_REQUIRED_INFORMATION", ["ordinal_result_reference_missing_v4"]),
    "second_told": (contract(goal(), goal(2, action="contact", kind="person", depends_on=["g1"], facts=[MESSAGE, ref("g1", ordinal=2)])), "trova bar e contatta il secondo", "ACCEPT", []),
    "consent": (contract(goal(action="buy", kind="ticket")), "compra dopo che ti avrò dato il permesso", "HOLD_POLICY_MISMATCH", ["explicit_delayed_consent_missing_v5"]),
    "both": (contract(goal(kind="transport", name="treno")), "parto da Lodi, non prenotare", "HOLD_MISSING_REQUIRED_INFORMATION", ["explicit_no_book_policy_missing_v5", "explicit_origin_missing"]),
}


def run(spark, cases, f):
    rows = [(k, c if isinstance(c, str) else json.dumps(c), t) for k, (c, t, *_) in cases.items()]
    rows += [("null", None, None)]
    return {r.case: r for r in f(spark.createDataFrame(rows, "case string, raw string, text string").coalesce(1)).collect()}


@pytest.mark.parametrize("cases,f", [(FIRST, guard_12), (ROUTED, lambda d: guard_12(d, routing=True)), (NEW, guard_13)], ids=["first", "routing", "chain"])
def test_guards(spark, cases, f):
    got = run(spark, cases, f)
    bad = {k: (got[k].status, got[k].codes) for k, (_, _, s, codes) in cases.items() if (got[k].status, got[k].codes) != (s, codes)}
    assert not bad
    assert got["null"].status in ("REJECT", "REJECT_INVALID")


def test_layers_add_up(spark):
    request = {"x": (contract(goal(kind="transport", name="treno")), "parto da Lodi, non prenotare", "", [])}
    got = [run(spark, request, lambda d, n=n: guard_13(d, layers=n))["x"] for n in (1, 2, 5)]
    assert [(x.status, len(x.codes)) for x in got] == [("ACCEPT", 0), ("HOLD_MISSING_REQUIRED_INFORMATION", 1), ("HOLD_MISSING_REQUIRED_INFORMATION", 2)]
