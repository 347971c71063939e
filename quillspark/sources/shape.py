"""The shape of contract JSON: what keys, kinds and words each version allows, checked as expressions over VARIANT.

A shape is a tuple: ("object", {key: shape}, required keys, rule), ("list", shape, least, distinct), or a
scalar: ("string", pattern or words, may be null), ("number", least, whole), ("boolean",), ("scalar", may be
null). `misfits` gives the paths that break it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.sources.contracts import once

#: Fixed values of the contract language.
OPERATORS = ["eq", "neq", "lt", "lte", "gt", "gte", "contains", "excludes", "before", "after", "near", "within", "between", "in", "not_in"]
ACTIONS_12 = ["find", "book", "buy", "compare", "contact", "rent", "monitor", "order", "hire", "cancel", "notify"]
ACTIONS_13 = [*ACTIONS_12, "reschedule"]
TARGET_TYPES = ["place", "accommodation", "real_estate", "transport", "vehicle", "product", "electronics", "flower", "professional_service", "person", "appointment", "medical_appointment", "reminder", "food", "ticket", "media", "education", "animal", "service", "drink"]
ROLES = ["search_date", "search_time", "arrival_time", "departure_time", "action_date", "action_time", "notification_date", "notification_time"]
GOAL_ID, NAME, ISO_CURRENCY, SOMETHING = r"^g[1-9][0-9]*$", r"^[a-z][a-z0-9_]*$", r"^[A-Z]{3}$", r"(?s)^.+$"

STRING, MAYBE, SCALAR = ("string", None, False), ("string", None, True), ("scalar", False)
TEXT = ("string", SOMETHING, False)


def one_of(*values: str) -> tuple:
    return ("string", list(values), False)


def _shapes(version: str) -> tuple:
    if version == "1.1":
        loose = ("scalar", True)
        predicate = ("object", {"property": TEXT, "operator": one_of(*OPERATORS), "value": loose, "value_to": loose, "unit": MAYBE, "currency": MAYBE, "reference": MAYBE}, ["property", "operator", "value"], None)
        target = ("object", {"name": TEXT, "type": MAYBE, "raw": TEXT}, ["name", "type", "raw"], None)
        gate = ("object", {"when": predicate, "then": TEXT, "otherwise": ("string", SOMETHING, True)}, ["when", "then", "otherwise"], "maybe")
        many = ("list", predicate, 0, False)
        buckets = {x: many for x in ("attributes", "constraints", "preferences")}
        goal = ("object", {"action": TEXT, "raw_action": TEXT, "target": target, **buckets, "gate": gate}, ["action", "raw_action", "target", *buckets], None)
        clarification = ("object", {"required": ("boolean",), "reason": MAYBE, "missing_fields": ("list", STRING, 0, False)}, ["required", "reason", "missing_fields"], None)
        return ("object", {"schema_version": one_of("1.1"), "goals": ("list", goal, 1, False), "clarification": clarification}, ["schema_version", "goals", "clarification"], None)
    new = version == "1.3"
    action, name, goal_id = one_of(*(ACTIONS_13 if new else ACTIONS_12)), ("string", NAME, False), ("string", GOAL_ID, False)
    ref = ("object", {"goal": goal_id, "field": name, "ordinal": ("number", 1, True)}, ["goal", "field"], None)
    held = {"value": SCALAR, "value_ref": ref, "value_to": SCALAR}
    test = ("object", {"field": name, "op": one_of(*OPERATORS), **held, "unit": TEXT, "currency": ("string", ISO_CURRENCY, False)}, ["field", "op"], "one value")
    strength = {"strength": one_of("hard", "soft")}
    fact = ("object", {**test[1], **strength}, ["field", "op", "strength"], "one value")
    missing = ("object", {"field": name, "blocks": one_of("search", "action"), "reason": one_of("unspecified", "unresolved_reference")}, ["field", "blocks", "reason"], None)
    policy = ("object", {"forbid": ("list", action, 0, True), "confirm_before": ("list", action, 0, True)}, [], "some key")
    order = ("object", {"field": name, "direction": one_of("asc", "desc")}, ["field", "direction"], None)
    target = ("object", {"name": TEXT, "type": one_of(*TARGET_TYPES) if new else TEXT}, ["name", "type"] if new else ["name"], None)
    goal = {"id": goal_id, "action": action, "target": target, "facts": ("list", fact, 0, False), "depends_on": ("list", goal_id, 0, True), "condition": ("object", {"goal": goal_id, "test": test}, ["goal", "test"], None), "missing": ("list", missing, 0, False), "policy": policy}
    if new:
        time = ("object", {"role": one_of(*ROLES), "op": one_of("eq", "before", "after", "between"), **held, **strength}, ["role", "op", "strength"], "one value")
        goal |= {"temporal": ("list", time, 0, False), "modifiers": ("object", {"sort": order, "limit": ("number", 1, True), "compare_count": ("number", 2, True)}, [], "some key")}
        context = ("object", {"scope": one_of("user", "conversation", "resource"), "field": name, "op": one_of(*OPERATORS), "value": SCALAR}, ["scope", "field", "op", "value"], None)
    else:
        goal |= {"ranking": order}
        context = test
    return ("object", {"schema_version": one_of(version), "kind": one_of("task", "non_actionable"), "goals": ("list", ("object", goal, ["id", "action", "target", "facts"], None), 0, False), "context": ("list", context, 0, False)}, ["schema_version", "kind", "goals"], None)


SHAPES = {v: _shapes(v) for v in ("1.1", "1.2", "1.3")}
_PATHS = "array<string>"


def misfits(v: Column, shape: tuple, path: str = "$") -> Column:
    """The paths below a VARIANT that break a shape; a path holds [] for any place of a list.

    A value and its keys are each made once: a column that is only named would be read again wherever it stands.
    """
    wrong, none = F.array(F.lit(path)), F.array().cast(_PATHS)
    if shape[0] == "object":
        _, keys, required, rule = shape
        names = F.array(*map(F.lit, keys))

        def broken(held: Column, there: Column) -> Column:
            parts = [
                F.transform(F.array_except(there, names), lambda k: F.concat(F.lit(f"{path}."), k)),
                F.transform(F.array_except(F.array(*map(F.lit, required)).cast(_PATHS), there), lambda k: F.concat(F.lit(f"{path}."), k)),
                *(F.when(F.array_contains(there, F.lit(k)), misfits(F.try_element_at(held, F.lit(k)), s, f"{path}.{k}")).otherwise(none) for k, s in keys.items()),
            ]
            if rule == "one value":
                parts.append(F.when(F.array_contains(there, F.lit("value")) == F.array_contains(there, F.lit("value_ref")), wrong).otherwise(none))
            if rule == "some key":
                parts.append(F.when(F.size(there) == 0, wrong).otherwise(none))
            return F.concat(*parts)

        def inside(v: Column) -> Column:
            # an object's keys and values are read at once; anything else has none
            return once(F.try_variant_get(v, "$", "map<string,variant>"), lambda held: F.when(held.isNotNull(), once(F.map_keys(held), lambda there: broken(held, there))).otherwise(wrong))

        if rule == "maybe":
            return once(v, lambda v: F.when(F.is_variant_null(v), none).otherwise(inside(v)))
        return inside(v)
    if shape[0] == "list":
        return _listed(v, shape, path)
    return once(v, lambda v: once(F.schema_of_variant(v), lambda kind: _misfits(v, kind, shape, path)))


def _listed(v: Column, shape: tuple, path: str) -> Column:
    _, of, least, distinct = shape
    wrong, none = F.array(F.lit(path)), F.array().cast(_PATHS)

    def inside(items: Column) -> Column:
        parts = [F.flatten(F.transform(items, lambda x: misfits(x, of, f"{path}[]")))]
        if least:
            parts.append(F.when(F.size(items) < least, wrong).otherwise(none))
        if distinct:
            texts = F.transform(items, lambda x: F.to_json(x))
            parts.append(F.when(F.size(F.array_distinct(texts)) < F.size(items), wrong).otherwise(none))
        return F.when(items.isNotNull(), F.concat(*parts)).otherwise(wrong)

    return once(F.try_variant_get(v, "$", "array<variant>"), inside)


def _misfits(v: Column, kind: Column, shape: tuple, path: str) -> Column:
    wrong, none = F.array(F.lit(path)), F.array().cast(_PATHS)
    number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    if shape[0] == "string":
        text = F.try_variant_get(v, "$", "string")
        ok = kind == "STRING"
        if isinstance(shape[1], list):
            ok &= text.isin(shape[1])
        elif shape[1]:
            ok &= text.rlike(shape[1])
        if shape[2]:
            ok |= kind == "VOID"
    elif shape[0] == "number":
        value = F.try_variant_get(v, "$", "double")
        ok = number & (value >= shape[1]) & (value == F.floor(value))
    elif shape[0] == "boolean":
        ok = kind == "BOOLEAN"
    else:
        ok = number | kind.isin("STRING", "BOOLEAN", *(["VOID"] if shape[1] else []))
    return F.when(ok, none).otherwise(wrong)


_NUMBER = r"(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\s*\d+\))"


def _object(**keys: str) -> str:
    return "OBJECT<(?:(?:" + "|".join(f"{k}: {v}" for k, v in keys.items()) + ")(?:, |(?=>)))*>"


def _several(of: str) -> str:
    return f"ARRAY<(?:VOID|{of})>"


_S = "STRING"
# scalars of several kinds are VARIANT, as are others among them, which their own kind tells
_SCALAR = f"(?:STRING|BOOLEAN|VARIANT|{_NUMBER})"
_SIMPLE_FACT = _object(field=_S, op=_S, value=_SCALAR, value_to=_SCALAR, unit=_S, currency=_S, strength=_S)
_SIMPLE_GOAL = _object(id=_S, action=_S, target=_object(name=_S, type=_S), facts=_several(_SIMPLE_FACT), depends_on=_several(_S))
#: The schema of contracts 1.2 and 1.3 that hold goals with facts and dependencies alone.
SIMPLE = "^" + _object(schema_version=_S, kind=_S, goals=_several(_SIMPLE_GOAL)) + "$"


def _sound(raw: Column, v: Column, c: Column, version: str) -> Column:
    """Whether a contract of the simple schema surely fits its shape; those this leaves out are asked place by place.

    A VARIANT's schema names each key and kind once for all places of a list, so what is absent, and words, are asked
    of the contract as typed rows (c), and a text with a null is left out.
    """
    new = version == "1.3"
    name = lambda x: F.coalesce(x.rlike(NAME), F.lit(False))
    within = lambda x, some: F.coalesce(x.isin(some), F.lit(False))
    text = lambda x: F.coalesce(F.length(x) > 0, F.lit(False))
    unless = lambda x, ok: x.isNull() | ok(x)

    def fact(f: Column) -> Column:
        return name(f["field"]) & within(f["op"], OPERATORS) & within(f["strength"], ["hard", "soft"]) & within(f["value_kind"], ["n", "s", "b"]) & unless(f["value_to_kind"], lambda x: x.isin("n", "s", "b")) & unless(f["unit"], text) & unless(f["currency"], lambda x: x.rlike(ISO_CURRENCY))

    def goal(g: Column) -> Column:
        kind = within(g["target"]["type"], TARGET_TYPES) if new else unless(g["target"]["type"], text)
        deps = unless(g["depends_on"], lambda d: F.forall(d, lambda x: x.rlike(GOAL_ID)) & (F.size(F.array_distinct(d)) == F.size(d)))
        return F.coalesce(g["id"].rlike(GOAL_ID), F.lit(False)) & within(g["action"], ACTIONS_13 if new else ACTIONS_12) & text(g["target"]["name"]) & kind & deps & g["facts"].isNotNull() & F.coalesce(F.forall(g["facts"], fact), F.lit(False))

    simple = ~F.contains(raw, F.lit("null")) & F.coalesce(F.schema_of_variant(v).rlike(SIMPLE), F.lit(False))
    return F.coalesce(simple & within(c["kind"], ["task", "non_actionable"]) & F.forall(c["goals"], goal), F.lit(False))


def structure(raw: Column, *versions: str, c: Column | None = None) -> Column:
    """The paths at which a contract's JSON breaks the shape of its version; null where it is of none of the versions (all, unless some are named).

    `c` is the contract as typed rows (`parsed`), if it is at hand: simple sound contracts are then told by their schema.
    """

    def found(v: Column) -> Column:
        def of(version: Column) -> Column:
            out = F.lit(None).cast(_PATHS)
            for name in versions or SHAPES:
                broken = misfits(v, SHAPES[name])
                if c is not None and name != "1.1":
                    broken = F.when(_sound(raw, v, c, name), F.array().cast(_PATHS)).otherwise(broken)
                out = F.when(version == name, broken).otherwise(out)
            return out

        return once(F.try_variant_get(v, "$.schema_version", "string"), of)

    return once(F.try_parse_json(raw), found)
