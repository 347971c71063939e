"""Contract rules as arrays of issues within the row: STRUCT<at, code, detail>; at is the goal's position, -1 the whole.

A contract is small, so every rule is an expression over its arrays and a table of contracts is checked in
one pass without an exchange. What several rules of a goal name is made once (`once`), and rules that only some
goals can break are asked of those alone. Version 1.2 and 1.3 have rules of their own; version 1.1 is left to its guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import plain
from quillspark.sources.contracts import listed, number, once

#: Fixed values of the contract language.
NUMERIC_OPS = ["lt", "lte", "gt", "gte", "within", "between"]
NUMERIC_FIELDS = ["price", "budget", "cost", "distance", "radius", "duration", "rating", "stars", "guests", "quantity", "age", "weight", "ram", "storage"]
UNIT_FIELDS = ["distance", "radius", "duration", "weight", "ram", "storage"]
MONEY_FIELDS = ["price", "budget", "cost"]
SINGLE_VALUED = ["date", "time", "arrival_time", "departure_time", "origin", "destination", "guests", "quantity", "price", "budget", "model", "selection", "recipient"]
TEMPORAL_FIELDS = ["date", "time", "arrival_time", "departure_time", "time_of_day"]
CLOCK_SLOTS = ["time", "arrival_time", "departure_time", "action_time", "notification_time", "search_time"]
READ_ONLY = ["find", "compare"]
CONSEQUENTIAL = ["book", "buy", "contact", "rent", "order", "hire", "cancel", "reschedule"]
FAMILIES = {"medical_appointment": "appointment", "electronics": "product", "flower": "product"}
KNOWN_TYPES = ["place", "accommodation", "real_estate", "transport", "vehicle", "product", "professional_service", "person", "appointment", "reminder", "food", "ticket", "media", "education", "animal", "service", "drink"]
COUNT_WORDS = {"due": 2, "tre": 3, "quattro": 4, "cinque": 5, "sei": 6}
COMPARED = r"\b(?:confronta|compara|confrontami)\s+(due|tre|quattro|cinque|sei|[2-6])\b"
RENTED = r"\b(bici|bicicletta|scooter|moto|automobile|auto|furgone|camper)\b"
FLOWN = r"\b(volo|aereo|flight)\b"
IDENTITY = ["appointment_id", "booking_id", "original_date", "original_time"]

ISSUES = "array<struct<at:int,code:string,detail:string>>"
_STRINGS = "array<string>"


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def issue(at: Column, code: str, detail: Column | str = "") -> Column:
    return F.struct(at.cast("int").alias("at"), F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def ruled(*rules: tuple[Column, Column]) -> Column:
    """The issues whose conditions hold."""
    return F.array_compact(F.array(*(F.when(ok, what) for ok, what in rules))).cast(ISSUES)


def joined(*arrays: Column) -> Column:
    return F.concat(*(listed(a, ISSUES) for a in arrays))


def given(f: Column, name: str = "value") -> Column:
    """Whether a fact holds a value; JSON null counts as none."""
    return F.coalesce(f[f"{name}_kind"] != "z", F.lit(False))


def facts_of(g: Column) -> Column:
    return F.coalesce(g["facts"], F.array().cast("array<struct<field:string,op:string,value:string,value_kind:string,value_to:string,value_to_kind:string,value_ref:struct<goal:string,field:string,ordinal:int>,unit:string,currency:string,strength:string>>"))


def times_of(g: Column) -> Column:
    return F.coalesce(g["temporal"], F.array().cast("array<struct<role:string,op:string,value:string,value_kind:string,value_to:string,value_to_kind:string,value_ref:struct<goal:string,field:string,ordinal:int>,unit:string,currency:string,strength:string>>"))


def fields_of(g: Column) -> Column:
    return F.transform(facts_of(g), lambda f: f["field"])


def roles_of(g: Column) -> Column:
    return F.transform(times_of(g), lambda t: t["role"])


def missing_of(g: Column) -> Column:
    return listed(F.transform(g["missing"], lambda m: m["field"]))


def has(array: Column, *names: str) -> Column:
    return F.arrays_overlap(array, words(list(names)))


def forbidden(g: Column) -> Column:
    return listed(g["policy"]["forbid"])


def confirmed(g: Column) -> Column:
    return listed(g["policy"]["confirm_before"])


def family(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), kind)


def value_key(f: Column, clock: Column | None = None) -> Column:
    """A value under which equal ones agree: case and blanks don't count, clocks have two digits, 5 is 5.0."""
    text = F.trim(F.regexp_replace(F.lower(f["value"]), r"\s+", " "))
    if clock is not None:
        text = F.when(clock & text.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$"), F.lpad(text, 5, "0")).otherwise(text)
    return F.concat(f["value_kind"], F.lit(":"), F.when(f["value_kind"] == "n", number(f).cast("string")).otherwise(text))


def fact_issues(f: Column, at: Column) -> Column:
    """The issues of one fact or condition by itself."""
    between, numeric, ref = f["op"] == "between", F.coalesce(f["value_kind"] == "n", F.lit(False)), f["value_ref"].isNotNull()
    low, high = number(f), number(f, "value_to")
    field = f["field"]
    return ruled(
        (between & ~given(f, "value_to"), issue(at, "between_missing_end", field)),
        (~between & given(f, "value_to"), issue(at, "unexpected_value_to", field)),
        (between & given(f, "value_to") & (low.isNull() | high.isNull() | (low > high)), issue(at, "invalid_numeric_range", field)),
        (f["op"].isin(NUMERIC_OPS) & given(f) & ~numeric, issue(at, "numeric_operator_type", field)),
        (field.isin(NUMERIC_FIELDS) & given(f) & ~numeric, issue(at, "numeric_field_type", field)),
        (field.isin(UNIT_FIELDS) & numeric & f["unit"].isNull(), issue(at, "unit_missing", field)),
        (field.isin(MONEY_FIELDS) & numeric & f["currency"].isNull(), issue(at, "currency_missing", field)),
        (ref & (f["unit"].isNotNull() | f["currency"].isNotNull()), issue(at, "ref_unit_unresolved", field)),
    )


def repeated(names: Column) -> Column:
    """Whether a value occurs twice."""
    return F.size(F.array_distinct(names)) < F.size(names)


def interval_conflicts(facts: Column) -> Column:
    """Fields whose hard numeric bounds, of one unit and currency, leave no value."""
    key = lambda f: F.struct(f["field"].alias("field"), f["unit"].alias("unit"), f["currency"].alias("currency"))

    def empty(hard: Column, k: Column) -> Column:
        low = lambda mine: F.array_max(F.transform(F.filter(mine, lambda f: f["op"].isin("gt", "gte", "eq", "between")), lambda f: F.struct(number(f).alias("v"), (f["op"] == "gt").alias("strict"))))
        top = lambda f: F.when(f["op"] == "between", F.coalesce(number(f, "value_to"), number(f))).otherwise(number(f))
        high = lambda mine: F.array_min(F.transform(F.filter(mine, lambda f: f["op"].isin("lt", "lte", "eq", "between")), lambda f: F.struct(top(f).alias("v"), (f["op"] != "lt").alias("open"))))
        crossed = lambda x: (x["low"]["v"] > x["high"]["v"]) | ((x["low"]["v"] == x["high"]["v"]) & (x["low"]["strict"] | ~x["high"]["open"]))
        of = once(F.filter(hard, lambda f: key(f).eqNullSafe(k)), lambda mine: once(F.struct(low(mine).alias("low"), high(mine).alias("high")), crossed))
        return F.coalesce(of, F.lit(False))

    def found(hard: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(F.array_distinct(F.transform(hard, key)), lambda k: empty(hard, k)), lambda k: k["field"]))

    # one fact's bounds cross only between two values of its own
    apt = repeated(F.transform(facts, lambda f: f["field"])) | F.exists(facts, lambda f: f["op"].eqNullSafe(F.lit("between")))
    return F.when(apt, once(F.filter(facts, lambda f: (f["strength"] == "hard") & number(f).isNotNull()), found))


def unequal_slots(items: Column, slot: str) -> Column:
    """Slots that hard equalities give several values; of facts only those that hold one value."""

    def several(fixed: Column, name: Column) -> Column:
        values = F.transform(F.filter(fixed, lambda f: f[slot] == name), lambda f: value_key(f, name.isin(CLOCK_SLOTS)))
        return F.size(F.array_distinct(values)) > 1

    fixed = F.filter(items, lambda f: (f["strength"] == "hard") & (f["op"] == "eq") & given(f) & (F.lit(slot == "role") | f[slot].isin(SINGLE_VALUED)))
    found = lambda fixed: F.filter(F.array_distinct(F.transform(fixed, lambda f: f[slot])), lambda name: several(fixed, name))
    return F.when(repeated(F.transform(items, lambda f: f[slot])), once(fixed, found))


def repeats(keys: Column) -> Column:
    """Positions (0-based) whose key occurred before."""
    return once(keys, lambda keys: F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: (i >= 0) & (F.array_position(keys, F.get(keys, i)) - 1 < i)))


def fact_keys(g: Column) -> Column:
    """A key for each fact without its strength."""
    return F.transform(facts_of(g), lambda f: F.to_json(f.dropFields("strength")))


def duplicate_facts(g: Column, at: Column) -> Column:
    # equal facts are of one field
    return F.when(repeated(fields_of(g)), F.transform(repeats(fact_keys(g)), lambda i: issue(at, "duplicate_fact", F.get(facts_of(g), i)["field"])))


def prior(goals: Column, g: Column, at: Column, name: Column) -> Column:
    """Whether a name is of a goal before this one that this one depends on."""
    before = F.transform(F.slice(goals, 1, at), lambda x: x["id"])
    return F.array_contains(before, name) & F.array_contains(listed(g["depends_on"]), name)


def in_cycle(goals: Column) -> Column:
    """Whether dependencies hold a cycle: goals without open dependencies are taken away, once for each goal there is."""
    start = F.sequence(F.lit(0), F.size(goals) - 1)

    def rid(left: Column, _: Column) -> Column:
        ids = F.transform(left, lambda i: F.get(goals, i)["id"])
        return F.filter(left, lambda i: F.arrays_overlap(listed(F.get(goals, i)["depends_on"]), ids))

    return (F.size(goals) > 0) & (F.size(F.aggregate(start, start, rid)) > 0)


def _whole(c: Column) -> Column:
    n, at = F.size(c["goals"]), F.lit(-1)
    ids = F.transform(c["goals"], lambda g: g["id"])
    return ruled(
        ((c["kind"] == "task") & (n == 0), issue(at, "task_without_goal")),
        ((c["kind"] == "non_actionable") & (n > 0), issue(at, "non_actionable_with_goals")),
        (F.size(F.array_distinct(ids)) < n, issue(at, "duplicate_goal_id")),
    )


def _missing(g: Column, at: Column, held: Column) -> Column:
    def rules(names: Column) -> Column:
        return joined(
            ruled((repeated(names), issue(at, "duplicate_missing"))),
            once(held, lambda held: F.transform(F.filter(names, lambda m: F.array_contains(held, m)), lambda m: issue(at, "missing_but_present", m))),
            F.transform(F.filter(g["missing"], lambda m: g["action"].isin(READ_ONLY) & (m["blocks"] == "action")), lambda m: issue(at, "wrong_block_phase", m["field"])),
        )

    return F.when(F.size(g["missing"]) > 0, once(missing_of(g), rules))


def _each(c: Column, rules) -> Column:
    return F.flatten(F.transform(c["goals"], rules))


def rules_12(c: Column) -> Column:
    """The issues of a contract of version 1.2."""
    goals = c["goals"]
    ids = F.transform(goals, lambda g: g["id"])

    def reference(g: Column, at: Column, name: Column) -> Column:
        return F.when(~F.array_contains(ids, name), issue(at, "unknown_reference", name)).when(~prior(goals, g, at, name), issue(at, "reference_without_prior_dependency", name))

    def rules(g: Column, at: Column) -> Column:
        facts, test = facts_of(g), g["condition"]["test"]
        names = F.concat(
            F.transform(F.filter(facts, lambda f: f["value_ref"].isNotNull()), lambda f: f["value_ref"]["goal"]),
            F.array_compact(F.array(g["condition"]["goal"], test["value_ref"]["goal"])),
        )
        own = F.transform(F.slice(goals, 1, at), lambda x: x["id"])
        deps = listed(g["depends_on"])
        return joined(
            F.transform(F.filter(deps, lambda d: ~F.array_contains(ids, d)), lambda d: issue(at, "unknown_dependency", d)),
            F.transform(F.filter(deps, lambda d: F.array_contains(ids, d) & ~F.array_contains(own, d)), lambda d: issue(at, "non_prior_dependency", d)),
            F.array_compact(F.transform(names, lambda x: reference(g, at, x))),
            F.when(test.isNotNull(), fact_issues(test, at)),
            F.flatten(F.transform(facts, lambda f: fact_issues(f, at))),
            duplicate_facts(g, at),
            F.transform(interval_conflicts(facts), lambda x: issue(at, "contradictory_hard_facts", x)),
            _missing(g, at, fields_of(g)),
            ruled(
                (F.arrays_overlap(forbidden(g), confirmed(g)), issue(at, "contradictory_policy", g["action"])),
                (F.array_contains(forbidden(g), g["action"]), issue(at, "forbidden_requested_action", g["action"])),
            ),
        )

    context = F.transform(c["context"], lambda x: F.concat(fact_issues(x, F.lit(-1)), ruled((x["value_ref"].isNotNull(), issue(F.lit(-1), "context_result_ref", x["field"])))))
    return joined(_whole(c), _each(c, rules), ruled((in_cycle(goals), issue(F.lit(-1), "dependency_cycle"))), F.flatten(context))


def _meaning(g: Column, at: Column, text: Column | None, new: bool) -> Column:
    """The rules that versions 1.2 and 1.3 share about what a goal means."""
    kind = F.coalesce(g["target"]["type"], F.lit(""))
    held = F.concat(fields_of(g), roles_of(g)) if new else fields_of(g)
    parts = F.struct(kind.alias("kind"), family(kind).alias("fam"), facts_of(g).alias("facts"), fields_of(g).alias("fields"), held.alias("held"), missing_of(g).alias("lacking"), forbidden(g).alias("forbid"), confirmed(g).alias("confirm"))
    return once(parts, lambda p: _meant(g, p, at, text, new))


def _meant(g: Column, p: Column, at: Column, text: Column | None, new: bool) -> Column:
    action, kind, fam, facts, held, lacking, forbid, confirm = g["action"], *(p[x] for x in ("kind", "fam", "facts", "held", "lacking", "forbid", "confirm"))
    need = lambda slot, said: ~F.array_contains(held, F.lit(slot)) & ~F.array_contains(lacking, F.lit(said))
    day, clock = ("action_date", "action_time") if new else ("date", "time")
    rules = [
        ((action == "notify") & (fam != "reminder"), issue(at, "notify_target_mismatch", kind)),
        ((action == "order") & (fam == "transport"), issue(at, "unsupported_action_target", "order transport")),
        ((action == "hire") & ~fam.isin("professional_service", "person"), issue(at, "unsupported_action_target", F.concat(F.lit("hire "), kind))),
        ((action == "reschedule") & (fam != "appointment"), issue(at, "unsupported_action_target", F.concat(F.lit("reschedule "), kind))),
        (F.arrays_overlap(confirm, forbid) | F.array_contains(forbid, action), issue(at, "policy_conflict", action)),
        ((F.size(confirm) > 0) & action.isin(CONSEQUENTIAL) & ~F.array_contains(confirm, action), issue(at, "policy_action_mismatch", action)),
        ((action == "contact") & ~has(p["fields"], "message") & ~has(lacking, "message"), issue(at, "missing_required_information", "contact.message")),
        ((action == "notify") & ~has(p["fields"], "message") & ~has(lacking, "message", "referent"), issue(at, "missing_required_information", "notify.message")),
    ]
    if new:
        rules.append((action.isin("cancel", "reschedule") & (fam == "appointment") & ~has(held, *IDENTITY) & ~has(lacking, *IDENTITY), issue(at, "missing_required_information", "appointment")))
    else:
        rules.append(((fam == "transport") & (action == "find") & F.exists(facts, lambda f: (f["field"] == "time") & f["op"].isin("before", "after")), issue(at, "temporal_role_ambiguous", "transport time")))

    def named(name: Column) -> Column:
        return ruled(
            ((action == "rent") & name.rlike(RENTED) & (fam != "vehicle"), issue(at, "vehicle_target_mismatch", kind)),
            ((action == "book") & F.contains(name, F.lit("tavolo")) & (need(day, "date") | need(clock, "time") | need("guests", "guests")), issue(at, "missing_required_information", "table booking")),
            ((action == "book") & name.rlike(FLOWN) & (need("origin", "origin") | need(day, "date")), issue(at, "missing_required_information", "flight booking")),
        )

    every = [unequal(at, facts, "field"), ruled(*rules), F.when(action.isin("rent", "book"), once(plain(F.coalesce(g["target"]["name"], F.lit(""))), named))]
    if new:
        every.append(once(times_of(g), lambda times: unequal(at, times, "role")))
    if text is not None:
        quantity = F.get(F.filter(facts, lambda f: (f["field"] == "quantity") & (f["op"] == "eq")), F.lit(0))
        actual = g["modifiers"]["compare_count"].cast("double") if new else number(quantity)
        lost = lambda asked: ruled((asked.isNotNull() & ~F.coalesce(actual == asked, F.lit(False)), issue(at, "cardinality_lost", asked.cast("string"))))
        every.append(F.when(action == "compare", once(counted(text, COMPARED), lost)))
    return joined(*every)


def unequal(at: Column, items: Column, slot: str) -> Column:
    return F.transform(unequal_slots(items, slot), lambda s: issue(at, "conflicting_hard_equality", s))


def counted(text: Column, pattern: str) -> Column:
    """The number, as a word or a digit, that a pattern's group finds in a plain text, or null."""
    table = F.create_map(*(F.lit(x) for kv in COUNT_WORDS.items() for x in kv))
    return once(F.regexp_extract(text, pattern, 1), lambda found: F.when(found != "", F.coalesce(F.try_element_at(table, found), found.try_cast("int"))))


def rules_13(c: Column, text: Column | None = None) -> Column:
    """The issues of a contract of version 1.3, some of them against the user's text."""
    goals = c["goals"]
    said = plain(text) if text is not None else None

    def rules(g: Column, at: Column) -> Column:
        kind = F.coalesce(g["target"]["type"], F.lit(""))
        before = F.transform(F.slice(goals, 1, at), lambda x: x["id"])
        parts = F.struct(kind.alias("kind"), family(kind).alias("fam"), facts_of(g).alias("facts"), times_of(g).alias("times"), before.alias("before"))
        return once(parts, lambda p: about(g, p, at))

    def about(g: Column, p: Column, at: Column) -> Column:
        action, facts, times = g["action"], p["facts"], p["times"]
        held = F.concat(fields_of(g), roles_of(g))
        bare = lambda p: F.transform(F.filter(held, lambda h: F.startswith(h, F.lit(p))), lambda h: F.substring(h, F.lit(len(p) + 1), F.length(h)))
        shown = F.concat(held, bare("action_"), bare("notification_"))
        roles = (
            F.when(action.isin(READ_ONLY), words(["search_date", "search_time", "arrival_time", "departure_time"]))
            .when(action == "notify", words(["notification_date", "notification_time"]))
            .when((action == "book") & (p["fam"] == "transport"), words(["action_date", "action_time", "arrival_time", "departure_time"]))
            .otherwise(words(["action_date", "action_time"]))
        )
        refs = F.concat(*(F.transform(F.filter(x, lambda f: f["value_ref"].isNotNull()), lambda f: f["value_ref"]["goal"]) for x in (facts, times)))
        ends = F.flatten(F.transform(times, lambda t: ruled(((t["op"] == "between") & ~given(t, "value_to"), issue(at, "between_missing_end", t["role"])), ((t["op"] != "between") & given(t, "value_to"), issue(at, "unexpected_value_to", t["role"])))))
        return joined(
            F.flatten(F.transform(facts, lambda f: fact_issues(f, at))),
            duplicate_facts(g, at),
            F.transform(interval_conflicts(facts), lambda x: issue(at, "contradictory_hard_facts", x)),
            _missing(g, at, shown),
            ends,
            ruled(
                (~p["fam"].isin(KNOWN_TYPES), issue(at, "unsupported_target_type", p["kind"])),
                (F.exists(facts, lambda f: f["field"].isin(TEMPORAL_FIELDS)), issue(at, "temporal_fact_without_role", action)),
                (g["modifiers"]["compare_count"].isNotNull() & (action != "compare"), issue(at, "compare_count_action_mismatch", action)),
                (g["modifiers"]["limit"].isNotNull() & (action == "compare"), issue(at, "compare_uses_limit", action)),
                (g["modifiers"]["sort"].isNotNull() & (action == "order"), issue(at, "order_sort_confusion", action)),
                (g["condition"].isNotNull() & ~prior(goals, g, at, g["condition"]["goal"]), issue(at, "invalid_condition_dependency", g["condition"]["goal"])),
            ),
            F.when(F.size(times) > 0, once(roles, lambda roles: F.transform(F.filter(roles_of(g), lambda r: ~F.array_contains(roles, r)), lambda r: issue(at, "temporal_role_action_mismatch", r)))),
            F.transform(F.filter(listed(g["depends_on"]), lambda d: ~F.array_contains(p["before"], d)), lambda d: issue(at, "non_prior_dependency", d)),
            F.transform(F.filter(refs, lambda r: ~prior(goals, g, at, r)), lambda r: issue(at, "invalid_reference", r)),
            _meaning(g, at, said, True),
        )

    return joined(_whole(c), _each(c, rules))


def meaning_12(c: Column, text: Column | None = None) -> Column:
    """What the rules of 1.3 about meaning say of a sound contract of version 1.2."""
    said = plain(text) if text is not None else None
    return joined(_whole(c), _each(c, lambda g, at: _meaning(g, at, said, False)))


def found(c: Column, text: Column | None = None) -> Column:
    """All issues of a contract, by its version; text as for rules_13."""
    none = F.array().cast(ISSUES)
    version = F.coalesce(c["schema_version"], F.lit(""))
    return F.when(c.isNull(), ruled((F.lit(True), issue(F.lit(-1), "not_object")))).when(version == "1.2", rules_12(c)).when(version == "1.3", rules_13(c, text)).when(version == "1.1", none).otherwise(ruled((F.lit(True), issue(F.lit(-1), "unsupported_version", version))))


def issues(cases: DataFrame, text: str | None = None) -> DataFrame:
    """(case, at, code, detail) of contracts (case, c); a contract without rows here passes these rules."""
    said = F.col(text) if text else None
    return cases.select("case", F.explode(found(F.col("c"), said)).alias("i")).select("case", "i.at", "i.code", "i.detail")


#: Codes of contracts that can't be read at all.
STRUCTURAL = ["not_object", "unsupported_version", "dependency_cycle", "duplicate_goal_id"]


def verdicts(cases: DataFrame, text: str | None = None) -> DataFrame:
    """(case, status, codes): ACCEPT without issues, REJECT for structural ones, else REVIEW."""
    codes = F.array_sort(F.array_distinct(F.transform(found(F.col("c"), F.col(text) if text else None), lambda i: i["code"])))
    x = cases.select("case", codes.alias("codes"))
    return x.select("case", F.when(F.size("codes") == 0, "ACCEPT").when(has(F.col("codes"), *STRUCTURAL), "REJECT").otherwise("REVIEW").alias("status"), "codes")
