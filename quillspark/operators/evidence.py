"""Evidence for values, demands left out, the safe repair and mock drafts, as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import evidence as E
from quillspark.functions.rowwise import dumped, loaded, rowwise
from quillspark.operators.requests import checked

_SOURCE = "source string, start int, end int, note string"

#: STRUCT<source, start, end, note> of (field, JSON value, text).
evidence = rowwise(_SOURCE, lambda field, value, text: tuple(E.ground(field, loaded(value), text or "")))
#: The same with trusted context (a JSON object) and results (JSON lists of {field, value, trusted}).
evidence_with = rowwise(_SOURCE, lambda field, value, text, context, provider, capability: tuple(E.ground(field, loaded(value), text or "", loaded(context), loaded(provider) or [], loaded(capability) or [])))
#: Codes of what a goal (JSON) leaves out of a train search's text.
omitted = rowwise("array<string>", lambda goal, text: E.omitted(g, text or "") if isinstance(g := loaded(goal), dict) and isinstance(g.get("target"), dict) else [])
#: Whether a slot's JSON value has its type.
typed = rowwise("boolean", lambda slot, value: E.typed(slot or "", loaded(value)))


def _repair(raw, text):
    c = loaded(raw)
    if c is None:
        return "HOLD", ["invalid_json"], None
    status, codes, out = E.repaired(c, text or "")
    return status, codes, None if out is None else dumped(out)


_repaired = rowwise("status string, codes array<string>, contract string", _repair)


def repair(cases: DataFrame) -> DataFrame:
    """cases (raw, text) with status (UNCHANGED, REPAIRED or HOLD), codes and contract; a repair must be valid, or it is held."""
    x = cases.withColumn("__r", _repaired(F.col("raw"), F.col("text"))).withColumn("__contract", F.col("__r.contract"))
    x = checked(x, "__contract", "__new", "1.3", text="text")
    failed = (F.col("__r.status") == "REPAIRED") & (F.size("__new_codes") > 0)
    return x.select(*cases.columns, F.when(failed, "HOLD").otherwise(F.col("__r.status")).alias("status"), F.when(failed, F.array(F.lit("repair_did_not_validate"))).otherwise(F.col("__r.codes")).alias("codes"), F.when(~failed, F.col("__contract")).alias("contract"))


def mock_handoff(plans: DataFrame, caps: dict[str, dict], version: str, plan: str = "plan") -> DataFrame:
    """plans (JSON) with status, codes and drafts; `caps` is a small registry by capability id."""

    def one(raw):
        p = loaded(raw)
        status, codes, drafts = E.mock_drafts(p, caps, version) if isinstance(p, dict) else ("HOLD", ["planner_permission_not_false"], [])
        return status, codes, [dumped(d) for d in drafts]

    made = rowwise("status string, codes array<string>, drafts array<string>", one)
    return plans.withColumn("__m", made(F.col(plan))).select(*plans.columns, "__m.status", "__m.codes", "__m.drafts")


def status_counts(handed: DataFrame) -> DataFrame:
    """(kind, name, n): how often each status and each code occurs."""
    name: Column = F.explode(F.concat(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("name"))), F.transform("codes", lambda c: F.struct(F.lit("code").alias("kind"), c.alias("name")))))
    return handed.select(name.alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
