"""Scores of conversational decisions: what a turn's prediction shares with its gold decision.

A turn has `gold` (struct of mode, operation, action, target, slots as a map, next), `predicted` (struct of mode,
operation, action, target, updates as an array of slot and value, reference as a struct of kind and
ordinal; null where there is no valid decision), and the replayed state's `status` and `next`. Everything is
within the row. Names and values are compared trimmed and in lower case; null equals null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Modes that ask for an action, steps that claim readiness, and steps at which that claim is wrong.
ACTIONABLE = ["ACTIONABLE_GOAL", "CONTINUATION", "ANSWER_TO_CLARIFICATION", "CONFIRMATION", "REJECTION", "CANCELLATION"]
READY = ["READY_TO_FINALIZE", "READY_FOR_DRY_RUN"]
NOT_READY = ["NO_ACTION", "ASK_USER", "DISCOVER_READ_ONLY", "RESOLVE_RESULT_REFERENCE", "CHECK_CONFIRMATION_BINDING"]
FLAGS = ["mode_correct", "operation_correct", "actionable_correct", "action_correct", "target_correct", "next_correct", "material_false_ready_candidate", "false_action", "false_nonaction"]
COUNTS = ["slot_recall", "slot_expected", "slot_hallucinations"]


def folded(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def turn_scores(turns: DataFrame, key: list[str], actionable: list[str] = ACTIONABLE) -> DataFrame:
    """(key, nine flags, slot_recall, slot_expected, slot_hallucinations, json_valid, state_status) of each turn."""
    gold, got = F.col("gold"), F.col("predicted")
    valid = got.isNotNull()
    slots = F.coalesce(gold["slots"], F.create_map().cast("map<string,string>"))
    expected = F.map_keys(slots)
    updates = F.coalesce(got["updates"], F.array().cast("array<struct<slot:string,value:string>>"))
    # a slot goes by its name behind the namespace; of repeated ones the last holds
    named = F.transform(updates, lambda u: F.struct(F.regexp_replace(u["slot"], r"^[^.]*\.", "").alias("slot"), u["value"].alias("value")))
    last = lambda k: F.get(F.reverse(F.filter(named, lambda u: u["slot"] == k)), F.lit(0))["value"]
    hits = F.size(F.filter(expected, lambda k: folded(last(k)).eqNullSafe(folded(F.element_at(slots, k)))))
    extra = F.size(F.filter(F.array_distinct(F.transform(named, lambda u: u["slot"])), lambda k: ~F.array_contains(expected, k)))
    reference = got["reference"]
    ordinal, rank = (F.array_contains(expected, k) & reference.isNotNull() for k in ("result_ordinal", "result_rank"))
    said = F.try_element_at(slots, F.lit("result_ordinal"))
    hits = hits + F.when(ordinal & reference["ordinal"].cast("string").eqNullSafe(said), 1).otherwise(0) + F.when(rank & reference["kind"].eqNullSafe(F.lit("cheapest")), 1).otherwise(0)
    extra = F.greatest(F.lit(0), extra - F.when(ordinal, 1).otherwise(0) - F.when(rank, 1).otherwise(0))
    wants, does = F.coalesce(gold["mode"].isin(actionable), F.lit(False)), F.coalesce(got["operation"] != "NO_GOAL", F.lit(False))
    same = lambda f: folded(got[f]).eqNullSafe(folded(gold[f]))
    flags = {
        "mode_correct": got["mode"].eqNullSafe(gold["mode"]),
        "operation_correct": got["operation"].eqNullSafe(gold["operation"]),
        "actionable_correct": wants == does,
        "action_correct": same("action"),
        "target_correct": same("target"),
        "next_correct": F.col("next").eqNullSafe(gold["next"]),
        "material_false_ready_candidate": F.coalesce(F.col("next").isin(READY) & gold["next"].isin(NOT_READY), F.lit(False)),
        "false_action": ~wants & does,
    }
    out = [(valid & c).alias(name) for name, c in flags.items()]
    # an invalid decision on an actionable turn is a missed action
    out.append((wants & ~F.when(valid, does).otherwise(False)).alias("false_nonaction"))
    counts = [F.when(valid, hits).otherwise(0).alias("slot_recall"), F.size(expected).alias("slot_expected"), F.when(valid, extra).otherwise(0).alias("slot_hallucinations")]
    return turns.select(*key, *out, *counts, valid.alias("json_valid"), F.when(valid, F.col("status")).alias("state_status"))


def turn_totals(scores: DataFrame, by: list[str]) -> DataFrame:
    """Turns, valid ones, accepted ones and the sums of all flags and counts, by group (one row without groups)."""
    accepted = F.coalesce(F.col("json_valid") & (F.col("state_status") != "STATE_REJECTED"), F.lit(False))
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in FLAGS + COUNTS]
    return scores.groupBy(*by).agg(F.count("*").alias("turns"), F.count_if("json_valid").alias("json_valid"), F.count_if(accepted).alias("schema_valid"), *sums)


PROJECTED = ["actionable_correct", "false_action", "false_nonaction", "first_action_correct", "first_target_correct", "goal_count_correct", "ready_candidate", "ask_user", "discover_read_only", "unknown_capability"]
SLOTS = ["slot_tp", "slot_gold", "slot_pred"]


def projection_scores(cases: DataFrame, key: list[str]) -> DataFrame:
    """Scores of a decision against a contract's projection: its first goal, its number of goals and its slot triples.

    A case has `gold` (struct of task, action, target, goals, slots), `got` (struct of task, action, target, more
    (further goals), slots; null where there is no valid decision) and `plan` (struct of ready, ask, discover, blocked; null
    where none was made). Slots are arrays of any struct, compared as sets.
    """
    gold, got, plan = F.col("gold"), F.col("got"), F.col("plan")
    yes = lambda c: F.coalesce(c, F.lit(False))
    wants, does = yes(gold["task"]), yes(got["task"])
    first = F.coalesce(gold["goals"], F.lit(0)) > 0
    proposed = F.when(does, 1 + F.coalesce(got["more"], F.lit(0))).otherwise(0)
    wanted = F.when(first, F.array_distinct(gold["slots"]))
    said = F.when(does, F.array_distinct(got["slots"]))
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    flags = [wants == does, does & ~wants, wants & ~does, first & does & got["action"].eqNullSafe(gold["action"]), first & does & got["target"].eqNullSafe(gold["target"]), proposed == F.coalesce(gold["goals"], F.lit(0)), yes(plan["ready"]), yes(plan["ask"]), yes(plan["discover"]), yes(plan["blocked"])]
    return cases.select(*key, *(f.alias(c) for f, c in zip(flags, PROJECTED, strict=True)), n(F.array_intersect(wanted, said)).alias("slot_tp"), n(wanted).alias("slot_gold"), n(said).alias("slot_pred"))


def projection_totals(scores: DataFrame, by: list[str]) -> DataFrame:
    """Cases and sums of all flags and slot counts by panel."""
    return scores.groupBy(*by).agg(F.count("*").alias("cases"), *(F.sum(F.col(c).cast("long")).alias(c) for c in PROJECTED + SLOTS))
