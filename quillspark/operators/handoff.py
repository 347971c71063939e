"""Handing contracts to explicit interfaces: every slot is mapped, or the whole contract is held.

Checks are queries that give (case, at, rank, status, detail); the first by goal and rank decides, as a
walk over the goals that stops at the first failure would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.planner import FEW
from quillspark.sources.contracts import Contracts

INTERFACE = "capability STRING, action STRING, type STRING, names ARRAY<STRING>, facts ARRAY<STRING>, temporal ARRAY<STRING>, modifiers ARRAY<STRING>, sort_fields ARRAY<STRING>, policies ARRAY<STRING>, results ARRAY<STRING>, conditions ARRAY<STRING>, required ARRAY<STRING>, references BOOLEAN, ordinals BOOLEAN, dependencies BOOLEAN"


def handoff(cases: DataFrame, interfaces: DataFrame, context: list[str] = ()) -> DataFrame:
    """Per contract (case, c): status, detail of the first failure, and execution_permitted (never).

    `interfaces` is a table of INTERFACE rows (null names take any target), broadcast up to FEW; `context` lists the
    context fields that have a parameter.
    """
    t = Contracts(cases)
    goals = t.goals
    spec = interfaces.select("capability", F.col("action").alias("s_action"), "type", "names", F.col("facts").alias("s_facts"), F.col("temporal").alias("s_temporal"), F.col("modifiers").alias("s_modifiers"), "sort_fields", "policies", "results", "conditions", "required", "references", "ordinals", "dependencies")
    spec = F.broadcast(spec) if spec.count() <= FEW else spec
    fits = (F.col("action") == F.col("s_action")) & (F.col("target.type") == F.col("type")) & (F.col("names").isNull() | F.array_contains("names", F.lower("target.name")))
    matched = goals.join(spec, fits, "left")
    n = matched.groupBy("case", "at").agg(F.count("capability").alias("n"))
    one = matched.join(n.where("n = 1"), ["case", "at"]).where("capability is not null")

    def held(df: DataFrame, rank: int, status: str, detail: Column) -> DataFrame:
        return df.select("case", F.col("at").cast("int").alias("at"), F.lit(rank).alias("rank"), F.lit(status).alias("status"), detail.cast("string").alias("detail"))

    empty = F.array().cast("array<string>")
    known = F.array(*map(F.lit, context)).cast("array<string>")
    has_context = F.coalesce(F.transform("c.context", lambda x: x["field"]), empty)
    loose = cases.withColumn("at", F.lit(-1)).withColumn("d", F.explode(F.array_except(has_context, known)))
    given = F.array_union(F.coalesce(F.transform("facts", lambda f: F.concat(F.lit("fact."), f["field"])), empty), F.coalesce(F.transform("temporal", lambda f: F.concat(F.lit("temporal."), f["role"])), empty))
    base = one.join(cases.select("case", F.transform(has_context, lambda x: F.concat(F.lit("context."), x)).alias("ctx")), "case").withColumn("lacking", F.array_except("required", F.array_union(given, "ctx")))
    slot = lambda df, part, name, allowed: df.select("*", F.posexplode(part).alias("pos", "x")).where(~F.array_contains(allowed, F.col(f"x.{name}")))
    prior = one.select("case", F.col("id").alias("dep"), F.col("at").alias("dep_at"), F.col("results").alias("dep_results"))
    deps = one.select("case", "at", "dependencies", F.explode("depends_on").alias("dep")).join(prior.drop("dep_results"), ["case", "dep"], "left")
    refs = one.select("case", "at", "references", "ordinals", F.explode("facts").alias("x")).where("x.value_ref IS NOT NULL").withColumn("dep", F.col("x.value_ref.goal")).join(prior, ["case", "dep"], "left")
    known_ref = F.coalesce((F.col("dep_at") < F.col("at")) & F.array_contains("dep_results", F.col("x.value_ref.field")), F.lit(False))
    cond = one.where("condition IS NOT NULL").withColumn("dep", F.col("condition.goal")).join(prior, ["case", "dep"], "left")
    good_cond = F.coalesce((F.col("dep_at") < F.col("at")) & F.array_contains("depends_on", F.col("dep")) & F.array_contains("dep_results", F.col("condition.test.field")) & F.array_contains("conditions", F.col("condition.test.op")), F.lit(False))
    used = F.array_compact(F.array(F.when(F.col("modifiers.sort").isNotNull(), "sort"), F.when(F.col("modifiers.limit").isNotNull(), "limit"), F.when(F.col("modifiers.compare_count").isNotNull(), "compare_count")))
    policy = F.array_union(F.coalesce("policy.forbid", empty), F.coalesce("policy.confirm_before", empty))
    out = [
        held(loose, 0, "HOLD_UNMAPPED_SLOT", F.concat(F.lit("context."), "d")),
        held(goals.join(n.where("n = 0"), ["case", "at"]), 1, "HOLD_NO_CAPABILITY", F.concat_ws(":", "id", "action", "target.type")),
        held(goals.join(n.where("n > 1"), ["case", "at"]), 1, "HOLD_AMBIGUOUS_CAPABILITY", F.col("id")),
        held(one.where(F.size("missing") > 0), 2, "HOLD_MISSING_INFORMATION", F.array_join(F.transform("missing", lambda m: m["field"]), ",")),
        held(base.where(F.size("lacking") > 0), 3, "HOLD_MISSING_INFORMATION", F.array_join(F.array_sort("lacking"), ",")),
        held(deps.where(~F.col("dependencies") | F.col("dep_at").isNull() | (F.col("dep_at") >= F.col("at"))), 4, "HOLD_UNMAPPED_SLOT", F.lit("depends_on")),
        held(slot(one, "facts", "field", "s_facts"), 5, "HOLD_UNMAPPED_SLOT", F.col("x.field")),
        held(refs.where(~F.col("references") | ~known_ref | (F.col("x.value_ref.ordinal").isNotNull() & ~F.col("ordinals"))), 5, "HOLD_UNMAPPED_SLOT", F.lit("reference")),
        held(slot(one, "temporal", "role", "s_temporal"), 6, "HOLD_UNMAPPED_SLOT", F.col("x.role")),
        held(one.withColumn("m", F.explode(F.array_except(used, "s_modifiers"))), 7, "HOLD_UNMAPPED_SLOT", F.col("m")),
        held(one.where(F.col("modifiers.sort").isNotNull() & ~F.array_contains("sort_fields", F.col("modifiers.sort.field"))), 7, "HOLD_UNMAPPED_SLOT", F.lit("sort")),
        held(one.withColumn("p", F.explode(F.array_except(policy, "policies"))), 8, "HOLD_UNMAPPED_SLOT", F.col("p")),
        held(cond.where(~good_cond), 9, "HOLD_UNMAPPED_SLOT", F.lit("condition")),
    ]
    first = reduce(DataFrame.unionByName, out).groupBy("case").agg(F.min(F.struct("at", "rank", "status", "detail")).alias("f"))
    idle = F.col("c.kind") == "non_actionable"
    return cases.join(first, "case", "left").select("case", F.when(idle, "NO_ACTION").otherwise(F.coalesce("f.status", F.lit("READY_FOR_PLANNING"))).alias("status"), F.when(idle, F.lit(None)).otherwise(F.col("f.detail")).alias("detail"), F.lit(False).alias("execution_permitted"))
