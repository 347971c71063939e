"""Contracts 1.1 to 1.3 as columns and tables: canonical forms, conversions, guards, scores and their rates.

Columns hold JSON text. Row functions run over Arrow batches; validity is checked by the column rules, and
rates are aggregates over counters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import convert as C
from quillspark.functions import guard as G
from quillspark.functions import mentions as M
from quillspark.functions import requests as R
from quillspark.functions.rowwise import dumped, loaded, rowwise
from quillspark.operators.scoring import rates
from quillspark.operators.tables import keep
from quillspark.operators.validate import rules_12, rules_13
from quillspark.sources.contracts import parsed
from quillspark.sources.shape import structure


def _plain(x):
    """Tuples of canonical forms as JSON."""
    if isinstance(x, R.Predicate):
        return {k: v for k, v in x._asdict().items() if v is not None}
    if isinstance(x, tuple):
        return [_plain(v) for v in x]
    return x


# ---------------------------------------------------------------- canonical forms

#: A text, and a JSON scalar, as they are compared.
text_form = rowwise("string", lambda x: None if x is None else R.text_form(x))
value_form = rowwise("string", lambda raw: dumped(R.value_form(loaded(raw))))
currency_form = rowwise("string", R.currency_form)
unit_form = rowwise("string", R.unit_form)
unit_shown = rowwise("string", R.unit_shown)


def _form(f):
    """A column function of a JSON object; null for anything that has no such form."""

    def one(raw):
        c = loaded(raw)
        try:
            return dumped(_plain(f(c))) if isinstance(c, dict) else None
        except (KeyError, TypeError, AttributeError):
            return None

    return rowwise("string", one)


predicate_key = _form(R.Predicate.of)
fact_key = _form(lambda p: R.Predicate.of(p).fact)
gate_form = _form(R.Gate.of)
contract_key = _form(R.contract_form)
canonical_12 = _form(C.canonical_12)
ordered_12 = _form(C.ordered_12)
narrow = _form(C.narrow)
present = _form(C.present)


def digest(raw: Column) -> Column:
    return F.sha2(contract_key(raw), 256)


def _of_contract(schema: str, f):
    return rowwise(schema, lambda raw: f(c) if isinstance(c := loaded(raw), dict) else None)


tags = _of_contract("array<string>", C.tags)
slot_updates = _of_contract("array<string>", lambda c: [dumped(x) for g in c.get("goals") or [] for x in C.slot_updates(g, c.get("context") or [])])
goal_slots = _of_contract("array<string>", lambda c: sorted({dumped(list(x)) for g in c.get("goals") or [] for x in C.goal_slots(g)}))
proposed_slots = _of_contract("array<string>", lambda d: [dumped(list(x)) for x in C.slot_set(d.get("updates") or [])])

# ---------------------------------------------------------------- guard 1.1

_VERDICT = "status string, codes array<string>, warnings array<string>, repairs array<string>, contract string"


def _verdict(v: G.Verdict) -> tuple:
    by = lambda s: sorted({f.code for f in v.findings if f.severity == s})
    return v.status, by("error"), by("warn"), v.repairs, None if v.contract is None else dumped(v.contract)


#: STRUCT<status, codes, warnings, repairs, contract> of a raw output and the user's text.
guard_11 = rowwise(_VERDICT, lambda raw, text: _verdict(G.guard(raw, text or "")))
#: How many pairs of a JSON list of predicates contradict each other.
contradictions = rowwise("bigint", lambda raw: sum(G.conflict(a, b) for i, a in enumerate(p) for b in p[i + 1 :]) if (p := [R.Predicate.of(x) for x in loaded(raw) or [] if isinstance(x, dict)]) else 0)
#: The contract that asks the user instead: (text, reason, candidate).
question = rowwise("string", lambda text, reason, candidate: dumped(G.question(text or "", reason, [], loaded(candidate))))

#: What a text says of a JSON number or text: the comparison, the role, and whether it is negated: (text, value).
strictness = rowwise("string", lambda text, value: M.strictness(text or "", loaded(value)))
number_role = rowwise("string", lambda text, value: M.number_role(text or "", loaded(value)))
negated = rowwise("boolean", lambda text, value: M.negated(text or "", loaded(value)))
#: "kind: words" of what a text asks for and its contract (JSON) leaves out.
left_out = rowwise("array<string>", lambda raw, text: [f"{k}: {w}" for k, w in M.left_out(loaded(raw) or {}, text or "")])

# ---------------------------------------------------------------- conversions


_STRINGS = "array<string>"
_EMPTY = '{"kind":"task","goals":[]}'


def checked(df: DataFrame, raw: str, name: str, *versions: str, text: str | None = None) -> DataFrame:
    """df with name_version and name_codes: the distinct codes of what is wrong with a contract of one of the versions.

    Codes are not_object, unsupported_version, schema, or those of the version's rules. The parsed contract
    is a column of its own below the rules, so it is made once.
    """
    x = df.withColumn("__c", parsed(F.coalesce(F.col(raw), F.lit("")))).withColumn("__shape", structure(F.col(raw), *versions, c=F.col("__c")))
    c, version = F.col("__c"), F.coalesce(F.col("__c.schema_version"), F.lit(""))
    codes = F.when(c.isNull(), F.array(F.lit("not_object"))).when(~version.isin(*versions), F.array(F.lit("unsupported_version"))).when(F.size("__shape") > 0, F.array(F.lit("schema")))
    if "1.2" in versions:
        codes = codes.when(version == "1.2", _codes(rules_12(c)))
    if "1.3" in versions:
        codes = codes.when(version == "1.3", _codes(rules_13(c, F.col(text) if text else None)))
    return x.select(*df.columns, version.alias(f"{name}_version"), codes.otherwise(F.array().cast(_STRINGS)).alias(f"{name}_codes"))


def _upgrade(raw):
    try:
        return dumped(C.upgraded(loaded(raw))), None
    except C.Held as e:
        return None, str(e)


_upgraded = rowwise("contract string, hold string", _upgrade)


def _codes(issues: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(issues, lambda i: i["code"])))


def _upgraded_of(x: DataFrame, raw: str, ok: Column, columns: list[str]) -> DataFrame:
    """x with __up and __hold: where ok, the contract 1.2 as 1.3, or why it has no such form."""
    x = x.withColumn("__ok", ok)
    x = x.withColumn("__u", F.when(F.col("__ok"), _upgraded(F.when(F.col("__ok"), F.col(raw)).otherwise(F.lit(_EMPTY)))))
    x = checked(x.withColumn("__made", F.col("__u.contract")), "__made", "__new", "1.3")
    hold = F.when(~F.col("__ok"), "source is not a valid contract 1.2").when(F.col("__made").isNull(), F.col("__u.hold")).when(F.size("__new_codes") > 0, F.concat(F.lit("projection held: "), F.array_join("__new_codes", ", ")))
    return x.select(*columns, F.when(hold.isNull(), F.col("__made")).alias("__up"), hold.alias("__hold"))


def upgrade(cases: DataFrame, raw: str = "raw") -> DataFrame:
    """cases with contract (1.3) or hold, for contracts 1.2; what doesn't hold as 1.3 is held with its codes."""
    x = _upgraded_of(checked(cases, raw, "__old", "1.2"), raw, F.size("__old_codes") == 0, cases.columns)
    return x.withColumnsRenamed({"__up": "contract", "__hold": "hold"})


def project(cases: DataFrame, raw: str = "raw") -> DataFrame:
    """cases with contract (as 1.3) and hold: 1.3 where it is valid, 1.2 upgraded, nothing else."""
    x = checked(cases, raw, "__own", "1.2", "1.3")
    version, codes = F.col("__own_version"), F.col("__own_codes")
    x = _upgraded_of(x, raw, (version == "1.2") & (F.size(codes) == 0), x.columns)
    hold = (
        F.when(F.array_contains(codes, "not_object"), "not_object")
        .when(F.array_contains(codes, "unsupported_version"), "unsupported_version")
        .when(version == "1.2", F.concat(F.lit("v12_projection_hold:"), F.col("__hold")))
        .when(F.size(codes) > 0, F.concat(F.lit("v13_invalid:"), F.array_join(codes, ",")))
    )
    kept = F.when(version == "1.2", F.col("__up")).otherwise(F.col(raw))
    return x.select(*cases.columns, F.when(hold.isNull(), kept).alias("contract"), hold.alias("hold"))


def _convert(any_action: bool):
    def one(raw, text):
        c = loaded(raw)
        if not isinstance(c, dict):
            return None, ["no_goal"]
        try:
            # a source that needs its guard's repair is no label
            out, reasons = C.converted(c, G.check(c, text or "").status, any_action=any_action)
        except (KeyError, TypeError, AttributeError):
            return None, ["source_guard_reject"]
        return (None if out is None else dumped(out)), reasons

    return rowwise("contract string, reasons array<string>", one)


def convert(cases: DataFrame, *, any_action: bool = False) -> DataFrame:
    """cases (raw 1.1, text) with contract (1.2) or the reasons that leave it to a reviewer."""
    x = cases.withColumn("__v", _convert(any_action)(F.col("raw"), F.col("text"))).withColumn("__made", F.col("__v.contract"))
    x = checked(x, "__made", "__new", "1.2")
    wrong = F.when(F.col("__made").isNotNull(), F.transform("__new_codes", lambda w: F.concat(F.lit("v12_"), w))).otherwise(F.array().cast(_STRINGS))
    return x.select(*cases.columns, F.when(F.size("__new_codes") == 0, F.col("__made")).alias("contract"), F.concat("__v.reasons", wrong).alias("reasons"))


def convertible(cases: DataFrame) -> DataFrame:
    """The cases whose contract 1.1 converts without a reason."""
    return convert(cases).where("size(reasons) = 0")


# ---------------------------------------------------------------- scores

_INTS = lambda names: ", ".join(f"{x} int" for x in names)


def _score_11(expected, got, text, equivalences):
    e, g = loaded(expected), loaded(got)
    if not isinstance(e, dict) or not isinstance(g, dict):
        return (None,) * (len(R.COUNTERS) + 1)
    n, errors = R.score(e, g, text or "", None if equivalences is None else [list(x) for x in equivalences])
    return (*(n[k] for k in R.COUNTERS), errors)


#: STRUCT of counters and errors: (expected, predicted, text, equivalences).
score_11 = rowwise(f"{_INTS(R.COUNTERS)}, errors array<string>", _score_11)


def rates_11(scored: DataFrame, *by: str) -> DataFrame:
    """The rates of scores 1.1 (their counters as columns) by group; nothing over nothing is 1."""
    n = scored.withColumn("cases", F.lit(1)).withColumn("fact_fp_value", F.col("fact_value_err"))
    pairs = {
        **{name: (num, ["cases"]) for name, num in {"goal_count_rate": "goal_count_ok", "missing_fact_rate": "fact_fn", "hallucinated_fact_rate": "fact_fp", "ungrounded_value_rate": "hallucinated_ungrounded", "duplicate_fact_rate": "duplicate_facts", "semantic_exact_rate": "semantic_exact", "cosmetic_exact_rate": "cosmetic_exact", "clarification_accuracy": "clarification_ok"}.items()},
        **{f"{x}_accuracy": (f"{x}_ok", [f"{y}_total"]) for x, y in {"action": "action", "target_name": "target", "target_type": "target", "bucket": "bucket", "operator": "operator", "unit": "unit", "currency": "currency", "reference": "reference", "gate": "gate"}.items()},
        "fact_precision": ("fact_tp", ["fact_tp", "fact_fp", "fact_value_err"]),
        "fact_recall": ("fact_tp", ["fact_tp", "fact_fn", "fact_value_err"]),
    }
    return rates(n, list(by), pairs).drop("fact_fp_value")


def bucket_rates(scored: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision and recall of each bucket."""
    rows = F.array(*(F.struct(F.lit(b).alias("bucket"), *(F.col(f"{b}_{x}").alias(x) for x in ("tp", "fp", "fn"))) for b in R.BUCKETS))
    flat = scored.select(*by, F.explode(rows).alias("b")).select(*by, "b.*")
    return rates(flat, [*by, "bucket"], {"precision": ("tp", ["tp", "fp"]), "recall": ("tp", ["tp", "fn"])})


def _score_12(expected, got):
    n = C.score_12(loaded(expected), loaded(got))
    return tuple(n[k] for k in C.COUNTERS_12)


_scored_12 = rowwise(_INTS(C.COUNTERS_12), _score_12)


def score_12(cases: DataFrame) -> DataFrame:
    """cases (expected, got) with schema_valid, issues and, where both are valid, counters."""
    x = checked(checked(cases, "expected", "__gold", "1.2"), "got", "__got", "1.2")
    both = (F.size("__gold_codes") == 0) & (F.size("__got_codes") == 0)
    given = lambda name: F.when(both, F.col(name)).otherwise(F.lit(_EMPTY))
    x = x.withColumn("__n", F.when(both, _scored_12(given("expected"), given("got"))))
    return x.select(*cases.columns, (F.size("__got_codes") == 0).alias("schema_valid"), F.col("__got_codes").alias("issues"), *(F.col(f"__n.{k}").alias(k) for k in C.COUNTERS_12))


def rates_12(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Rates over all cases and over the valid ones; nothing over nothing is null. A row stands for `weight` cases (1)."""
    n = scored.withColumn("cases", F.lit(1)).withColumn("valid", F.col("schema_valid").cast("int")).withColumn("success", F.coalesce("complete_success", F.lit(0))).withColumn("wrong", F.coalesce(1 - F.col("complete_success"), F.lit(0)))
    pairs = {
        "schema_valid_rate": ("valid", ["cases"]),
        "complete_success_rate": ("success", ["cases"]),
        "schema_valid_but_wrong_rate": ("wrong", ["cases"]),
        "goal_count_accuracy": ("goal_count_correct", ["valid"]),
        **{f"{p}_accuracy": (f"{p}_correct", ["goals"]) for p in C.SIDE_BY_SIDE},
        **{f"{f}_{name}": (f"{f}_tp", [f"{f}_tp", f"{f}_{other}"]) for f in C.FAMILIES for name, other in (("precision", "fp"), ("recall", "fn"))},
    }
    return rates(n, list(by), pairs, empty=None, digits=6, weight=weight)


def _score_13(expected, got):
    n = C.score_13(loaded(expected), loaded(got))
    return tuple(n[k] for k in C.COUNTERS_13)


_scored_13 = rowwise(_INTS(C.COUNTERS_13), _score_13)


def score_13(cases: DataFrame) -> DataFrame:
    """cases (expected, got, text) with eligibility, holds, the guard's status and codes, and counters of eligible ones.

    Projections and decisions are written once, so each plan holds one set of rules.
    """
    from quillspark.operators.guards import guard_13

    x = keep(project(cases, "expected").withColumnRenamed("contract", "gold_contract").withColumnRenamed("hold", "gold_hold"), "score-gold")
    x = keep(project(x, "got").withColumnRenamed("contract", "got_contract").withColumnRenamed("hold", "candidate_hold"), "score-got")
    x = keep(guard_13(x.withColumn("raw", F.col("got")), layers=0).withColumnRenamed("status", "guard_status").withColumnRenamed("codes", "guard_codes"), "score-guard")
    x = checked(x, "got_contract", "issue", "1.3", text="text")
    eligible, there = F.col("gold_contract").isNotNull(), F.col("got_contract").isNotNull()
    x = x.withColumn("__n", F.when(eligible, _scored_13(F.coalesce("gold_contract", F.lit(_EMPTY)), F.col("got_contract"))))
    out = [F.col(f"__n.{k}").alias(k) for k in C.COUNTERS_13]
    accepted = (F.col("guard_status") == "ACCEPT").cast("int").alias("guard_accept")
    valid = (there & (F.size("issue_codes") == 0)).cast("int").alias("invariant_valid")
    return x.select(*cases.columns, eligible.alias("eligible"), "gold_hold", "candidate_hold", "guard_status", "guard_codes", accepted, valid, *out)


def rates_13(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Rates of the eligible cases, and how many were accepted but differ, or held though equal. A row stands for `weight` cases (1)."""
    n = scored.where("eligible").withColumn("cases", F.lit(1))
    n = n.withColumn("accepted_not_canonical", F.col("guard_accept") * (1 - F.col("canonical_equal"))).withColumn("held_canonical", (1 - F.col("guard_accept")) * F.col("canonical_equal")).withColumn("candidate_holds", F.col("candidate_hold").isNotNull().cast("int"))
    pairs = {
        "canonical_exact": ("canonical_equal", ["cases"]),
        "action": ("action_correct", ["gold_goals"]),
        "target": ("target_correct", ["gold_goals"]),
        "fact_precision": ("fact_tp", ["fact_pred"]),
        "fact_recall": ("fact_tp", ["fact_gold"]),
        "temporal_precision": ("temporal_tp", ["temporal_pred"]),
        "temporal_recall": ("temporal_tp", ["temporal_gold"]),
        "guard_coverage": ("guard_accept", ["cases"]),
        **{f"{x}_rate": (x, ["cases"]) for x in ("accepted_not_canonical", "held_canonical", "candidate_holds")},
    }
    return rates(n, list(by), pairs, empty=None, weight=weight)


def compared(cases: DataFrame) -> DataFrame:
    """cases (expected, got) with literal_equal, canonical_equal, presence_equal and valid (of got)."""
    x = checked(checked(cases, "expected", "__gold", "1.2", "1.3"), "got", "__got", "1.2", "1.3")
    e, g = F.col("expected"), F.col("got")
    both = (F.size("__gold_codes") == 0) & (F.size("__got_codes") == 0)
    same = lambda f: both & F.coalesce(f(e) == f(g), F.lit(False))
    literal = F.coalesce(F.to_json(F.try_parse_json(e)) == F.to_json(F.try_parse_json(g)), F.lit(False))
    return x.select(*cases.columns, (F.size("__got_codes") == 0).alias("valid"), literal.alias("literal_equal"), same(narrow).alias("canonical_equal"), same(lambda v: present(narrow(v))).alias("presence_equal"))


_DELIVERED = "json_valid boolean, schema_valid boolean, guard string, error string, exact boolean, accepted_but_wrong boolean, asked_rightly boolean, needless_question boolean"


def _evaluate(raw, expected, text):
    """Flags of a model's raw output against the expected contract 1.1; those that need one are null without it."""
    from quillspark.functions.strictjson import extract

    json_valid = isinstance(loaded(raw), dict)
    found, code = extract(raw)
    if code:
        return json_valid, False, None, code, *[None] * 4
    c, e = loaded(found), loaded(expected)
    v = G.check(c, text or "")
    schema_valid = all(f.code != "schema_violation" for f in v.findings)
    accepted = v.status in ("ACCEPT", "REPAIRED")
    if e is None or not schema_valid:
        return json_valid, schema_valid, v.status, None if schema_valid else "schema", *[None] * 4
    exact = accepted and R.contract_form(e) == R.contract_form(v.contract)
    wanted = bool((e.get("clarification") or {}).get("required"))
    asks = not accepted or bool((c.get("clarification") or {}).get("required"))
    return json_valid, True, v.status, None, exact, accepted and not exact, wanted == asks, asks and not wanted


#: STRUCT of flags: (raw output, expected contract or null, text).
evaluate = rowwise(_DELIVERED, _evaluate)


def static_evaluation(gold: DataFrame, predictions: DataFrame, key: str = "id", score: Callable[[DataFrame], DataFrame] = score_12) -> DataFrame:
    """The rates 1.2 of predictions (id, got) against gold (id, expected), scored by `score`; stops where the ids differ."""
    from quillspark.operators.scoring import complete_pairs

    return rates_12(score(complete_pairs(gold.select(key, "expected"), predictions.select(key, "got"), key)))


def judged_11(cases: DataFrame) -> DataFrame:
    """cases (raw, text) with the guard's verdict v."""
    return cases.withColumn("v", guard_11(F.col("raw"), F.col("text")))


def guard_false_alarms(cases: DataFrame) -> DataFrame:
    """The expected contracts 1.1 (raw, text; their verdict v, if it is known) that the guard doesn't accept as they are, with its codes."""
    x = cases if "v" in cases.columns else judged_11(cases)
    cases = cases.drop("v")
    return x.where("v.status <> 'ACCEPT'").select(*cases.columns, "v.status", "v.codes", "v.repairs")


def schema_totals(files: DataFrame, by: str = "file") -> DataFrame:
    """(file, ok, failed) of contracts (raw): whether they fit their version's shape."""
    ok = F.coalesce(F.size(structure(F.col("raw"))) == 0, F.lit(False))
    return files.groupBy(by).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


