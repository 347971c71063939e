"""Rates, taxonomies, comparisons and gates over per-case counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.operators.matching import ratio


def rates(counters: DataFrame, by: list[str], pairs: dict[str, tuple[str, list[str]]], empty: float | None = 1.0, digits: int = 4, weight: str | None = None) -> DataFrame:
    """Sums of counters by group and, for each name, numerator over the sum of its denominators.

    `empty` (1, or null) is the rate of 0 over 0; rates are rounded half to even. A row stands for `weight` cases (1).
    """
    used = sorted({c for num, dens in pairs.values() for c in (num, *dens)})
    if weight is None:
        totals = [F.count("*").alias("n"), *(F.sum(c).alias(c) for c in used)]
    else:
        totals = [F.coalesce(F.sum(weight), F.lit(0)).alias("n"), *(F.sum(F.col(c) * F.col(weight)).alias(c) for c in used)]
    sums = counters.groupBy(*by).agg(*totals)
    for name, (num, dens) in pairs.items():
        den = sum((F.col(c) for c in dens[1:]), F.col(dens[0]))
        sums = sums.withColumn(name, F.bround(ratio(F.col(num), den, empty), digits))
    return sums


def by_tag(cases: DataFrame, tags: str, *aggregates: Column) -> DataFrame:
    """Aggregates by each tag of a case (a case with several tags counts in each)."""
    return cases.withColumn("tag", F.explode(F.array_distinct(tags))).groupBy("tag").agg(F.count("*").alias("n"), *aggregates)


def taxonomy(cases: DataFrame, errors: str) -> DataFrame:
    """How many cases have each error, most first."""
    return cases.select(F.explode(F.array_distinct(errors)).alias("error")).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error")


def paired(before: DataFrame, after: DataFrame, key: list[str], flag: str) -> DataFrame:
    """(key, change): cases whose flag differs between two runs; null differs from both values."""
    both = before.select(*key, F.col(flag).alias("a")).join(after.select(*key, F.col(flag).alias("b")), key)
    change = F.when(F.coalesce("b", F.lit(False)), "gain").otherwise("loss")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*key, change.alias("change"))


def complete_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two sides that must hold the same keys; stops where they don't."""
    k = left.select(key, F.lit(True).alias("l")).join(right.select(key, F.lit(True).alias("r")), key, "full")
    bad = k.where(F.col("l").isNull() | F.col("r").isNull()).limit(5).collect()
    if bad:
        raise ValueError(f"keys of one side only: {sorted(str(r[key]) for r in bad)}")
    return left.join(right, key)


def best(reports: DataFrame, high: list[str], low: list[str], tie: str) -> DataFrame:
    """The report that is best by the `high` columns in order, then least by the `low` ones."""
    order = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias(c) for c in high), *((-F.coalesce(F.col(c).cast("double"), F.lit(float("inf")))).alias(c) for c in low))
    return reports.orderBy(F.desc(order), tie).limit(1)


def regressions(reports: DataFrame, by: str, order: str, rate: str, tolerance: float = 0.01) -> DataFrame:
    """Groups whose last rate fell by more than the tolerance from the one before."""
    w = Window.partitionBy(by).orderBy(order)
    last = reports.withColumn("before", F.lag(rate).over(w)).withColumn("next", F.lead(order).over(w)).where("next is null")
    return last.where(F.col(rate) - F.col("before") < -tolerance).select(by, "before", rate)


def gates(report: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """(gate, verdict) of a one-row report: pass, fail or absent."""
    has = set(report.columns)
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), (F.col(g) if g in has else F.lit(None)).cast("double").alias("value"), F.lit(float(w)).alias("want")) for g, w in wanted.items()))
    x = report.select(F.explode(rows).alias("x")).select("x.*")
    return x.select("gate", F.when(F.col("value").isNull(), "absent").when(F.col("value") == F.col("want"), "pass").otherwise("fail").alias("verdict"))


#: The review label of a plan that must not run, and actions that only read.
RISK = "clear_material_or_policy_risk"
READING = ["find", "compare"]


def verdict(ready: Column, exact: Column, risk: Column, read_only: Column, pending: Column) -> Column:
    """Outcome of a replayed plan: a labelled risk decides first, then whether the prediction is exact."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(risk == RISK), F.when(yes(ready), "FALSE_ACCEPT").otherwise("CORRECT_HOLD"))
        .when(yes(exact) & yes(ready), "CORRECT_ACCEPT")
        .when(yes(exact) & yes(read_only), "FALSE_HOLD")
        .when(yes(exact), "CORRECT_HOLD")
        .when(yes(pending), "UNRESOLVED_GOLD")
        .otherwise("UNRESOLVED_ONTOLOGY")
    )


def reads_only(c: Column) -> Column:
    """Whether a contract 1.3 only reads: nothing to do, or goals that find or compare with nothing missing or conditional."""
    free = lambda g: F.coalesce(g["action"].isin(READING), F.lit(False)) & (F.coalesce(F.size(g["missing"]), F.lit(0)) == 0) & g["condition"].isNull()
    return (c["kind"] == "non_actionable") | F.forall(c["goals"], free)


def replay_verdicts(gold: DataFrame, predictions: DataFrame, review: DataFrame, flagged: DataFrame) -> DataFrame:
    """(case, verdict, ready, exact, label, pending): gold (case, c or read_only) and predictions (case, status, exact) of the same cases.

    `review` holds (case, label) of reviewed risks, `flagged` the cases whose gold waits for a reviewer; both at
    most once a case. Stops where gold and predictions hold different cases.
    """
    read_only = F.col("read_only") if "read_only" in gold.columns else reads_only(F.col("c")).alias("read_only")
    x = complete_pairs(gold.select("case", read_only), predictions.select("case", F.col("status").isin("READY_FOR_DRY_RUN", "NO_ACTION").alias("ready"), "exact"), "case")
    x = x.join(review.select("case", "label"), "case", "left").join(flagged.select("case", F.lit(True).alias("pending")), "case", "left").na.fill(False, ["pending"])
    return x.select("case", verdict(F.col("ready"), F.col("exact"), F.col("label"), F.col("read_only"), F.col("pending")).alias("verdict"), "ready", "exact", "label", "pending")


def replay_totals(verdicts: DataFrame) -> DataFrame:
    """One row: how many cases have each verdict, and how many clear risks were held or accepted."""
    names = ["FALSE_ACCEPT", "CORRECT_HOLD", "CORRECT_ACCEPT", "FALSE_HOLD", "UNRESOLVED_GOLD", "UNRESOLVED_ONTOLOGY"]
    clear = F.coalesce(F.col("label") == RISK, F.lit(False))
    return verdicts.agg(F.count("*").alias("cases"), *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in names), F.count_if(clear & ~F.col("ready")).alias("clear_blocked"), F.count_if(clear & F.col("ready")).alias("clear_accepted"))


#: The label of accepted plans that matter, and how labels of doubt begin.
ROUTING_RISK, UNCERTAIN, SURE = "material_or_routing_risk", "uncertain_", "exact_correct"


def guard_table(verdicts: DataFrame, guard: str = "guard") -> DataFrame:
    """A row for each guard over the verdicts (guard, status, exact, label) of the same cases.

    What it accepts, reviews and rejects, its coverage, exact contracts that it holds and wrong ones that it
    accepts, and by review label how many risks are accepted or held, doubtful ones accepted, right ones held.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    accepted, exact, label = yes(F.col("status") == "ACCEPT"), yes(F.col("exact")), F.coalesce("label", F.lit(""))
    n = F.count_if
    return verdicts.groupBy(guard).agg(
        n(accepted).alias("accept"),
        n(F.col("status") == "REVIEW").alias("review"),
        n(F.col("status") == "REJECT").alias("reject"),
        (n(accepted) / F.count("*")).alias("coverage"),
        n(accepted & ~exact).alias("accepted_exact_wrong"),
        n(~accepted & exact).alias("exact_correct_held"),
        n(accepted & (label == ROUTING_RISK)).alias("accepted_material_or_routing_risk"),
        n(~accepted & (label == ROUTING_RISK)).alias("held_material_or_routing_risk"),
        n(accepted & label.startswith(UNCERTAIN)).alias("accepted_uncertain"),
        n(~accepted & (label == SURE)).alias("held_exact_correct"),
    )


def guard_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, statuses and codes before and after) of cases that two guards judge differently."""
    a = before.select(*key, F.col("status").alias("before"), F.col("codes").alias("before_codes"))
    b = after.select(*key, F.col("status").alias("after"), F.col("codes").alias("after_codes"))
    differ = ~(F.col("before").eqNullSafe(F.col("after")) & F.col("before_codes").eqNullSafe(F.col("after_codes")))
    return a.join(b, key).where(differ)


def release_rates(cases: DataFrame, flags: list[str]) -> DataFrame:
    """One row: how many cases are right, the precision of those accepted, and for each flag its cases and how many are right.

    A case has `accepted`, `exact` and the boolean flags (mandatory, gate, ...); rates of nothing are null.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    share = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b))
    per = [x for f in flags for x in (F.count_if(yes(f)).alias(f"{f}_cases"), share(yes("exact"), yes(f)).alias(f"{f}_rate"))]
    return cases.agg(F.count("*").alias("cases"), F.count_if(yes("exact")).alias("exact"), share(yes("exact"), yes("accepted")).alias("accepted_precision"), *per)
