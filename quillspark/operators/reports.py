"""Reports, run summaries and audits: nested JSON read once, counters as long tables, small files written whole."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators.scoring import rates
from quillspark.operators.tables import remove
from quillspark.sources.contracts import listed
from quillspark.operators.validate import facts_of

#: A report's columns and where they stand in it.
COLUMNS = {
    "label": ("label", "string"), "n": ("examples", "bigint"), "mandatory": ("release_gates.mandatory_rate", "double"), "acc_wrong": ("release_gates.accepted_but_wrong", "double"),
    "json_ok": ("release_gates.json_validity", "double"), "exact": ("guarded.contract.semantic_exact_rate", "double"), "bucket": ("guarded.roles.bucket_accuracy", "double"),
    "operator": ("guarded.roles.operator_accuracy", "double"), "recall": ("guarded.facts.recall", "double"), "precision": ("guarded.facts.precision", "double"),
    "halluc": ("guarded.fidelity.hallucinated_fact_rate", "double"), "blocked": ("guard.blocked_rate", "double"),
}


def read_reports(spark: SparkSession, path: str, but: str = "BEST.json") -> DataFrame:
    """(path, raw) of the JSON objects in a folder; files that can't be read as one are left out."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return files.where(~F.col("path").endswith(f"/{but}") & F.coalesce(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(False)))


def dig(raw: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path of a JSON text, null if it is absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(raw), f"$.{path}", kind)


def accepted_precision(raw: Column) -> Column:
    """The share of accepted contracts that are right; 0 where none is accepted, null without counts."""
    count = lambda s: F.coalesce(dig(raw, f"guard.statuses.{s}", "double"), F.lit(0.0))
    accepted = count("ACCEPT") + count("REPAIRED")
    wrong = F.coalesce(dig(raw, "release_gates.accepted_but_wrong", "double"), F.lit(0.0))
    return F.when(accepted > 0, 1 - wrong / accepted).otherwise(F.lit(0.0))


def report_rows(reports: DataFrame) -> DataFrame:
    """The columns of reports (raw) that comparisons show."""
    return reports.select(*(c for c in reports.columns if c != "raw"), *(dig(F.col("raw"), p, k).alias(name) for name, (p, k) in COLUMNS.items()), accepted_precision(F.col("raw")).alias("acc_prec"))


def write_one(df: DataFrame, path: str) -> None:
    """A small table as one JSON object a line, written beside its place and moved there, so it is old or new, never half."""
    spark, new = df.sparkSession, f"{path}.new"
    df.coalesce(1).write.mode("overwrite").json(new)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    remove(spark, path)
    if not store.rename(path_of(new), path_of(path)):
        raise OSError(f"{new} could not be moved to {path}")


def append_series(df: DataFrame, path: str) -> None:
    """Rows added to a CSV time series; each call adds files and leaves those that are there."""
    df.write.mode("append").option("header", True).csv(path)


def sampled(metrics: DataFrame, at: str, every: str, value: str) -> DataFrame:
    """A metric stream in windows: (window start, samples, mean, most); works on batches and streams."""
    return metrics.groupBy(F.window(at, every).alias("w")).agg(F.count("*").alias("samples"), F.avg(value).alias("mean"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), "samples", "mean", "most")


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Runs (json_valid, schema_valid, labeled, exact, tokens, seconds, ttft, vram) by group; token rate is weighted, nulls of ttft don't count."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    x = runs.withColumn("one", F.lit(1)).withColumn("ok", flag("exact") * flag("json_valid") * flag("schema_valid")).withColumn("seen", flag("labeled"))
    out = x.groupBy(*by).agg(
        F.count("*").alias("cases"),
        (F.sum(flag("json_valid")) / F.count("*")).alias("json_valid_rate"),
        (F.sum(flag("schema_valid")) / F.count("*")).alias("schema_valid_rate"),
        F.try_divide(F.sum(flag("exact")), F.sum("seen")).alias("semantic_success_rate"),
        F.try_divide(F.sum("ok"), F.sum("seen")).alias("complete_success_rate"),
        F.avg("seconds").alias("latency_mean"),
        F.try_divide(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"),
        F.avg("ttft").alias("ttft_mean"),
        F.coalesce(F.max("vram"), F.lit(0)).alias("peak_vram"),
    )
    return out


def contract_distribution(cases: DataFrame, text: str | None = None) -> DataFrame:
    """(counter, n): what contracts (c) hold, with actions and facts a goal as counters of their own."""
    goals = F.col("c.goals")
    count = lambda name, n: F.struct(F.lit(name).alias("counter"), n.cast("long").alias("n"))
    some = lambda f: F.size(F.filter(goals, f))
    facts = F.flatten(F.transform(goals, facts_of))
    strength = lambda s: F.size(F.filter(facts, lambda f: f["strength"] == s))
    fixed = [
        count("rows", F.lit(1)),
        count("non_actionable", (F.col("c.kind") == "non_actionable").cast("int")),
        count("multi_goal", (F.size(goals) > 1).cast("int")),
        count("context", (F.coalesce(F.size("c.context"), F.lit(0)) > 0).cast("int")),
        count("goals", F.size(goals)),
        count("facts", F.size(facts)),
        count("soft_facts", strength("soft")),
        count("hard_facts", strength("hard")),
        count("missing", F.size(F.flatten(F.transform(goals, lambda g: listed(F.transform(g["missing"], lambda m: m["field"])))))),
        count("dependency", some(lambda g: F.size(listed(g["depends_on"])) > 0)),
        count("condition", some(lambda g: g["condition"].isNotNull())),
        count("confirmation", some(lambda g: F.size(listed(g["policy"]["confirm_before"])) > 0)),
        count("prohibition", some(lambda g: F.size(listed(g["policy"]["forbid"])) > 0)),
        count("ranking", some(lambda g: g["ranking"].isNotNull())),
        count("value_reference", F.size(F.filter(facts, lambda f: f["value_ref"].isNotNull()))),
    ]
    if text:
        fixed.append(count("long_input_100_chars", (F.length(text) >= 100).cast("int")))
    own = F.concat(
        F.array(*fixed),
        F.transform(goals, lambda g: F.struct(F.concat(F.lit("action:"), g["action"]).alias("counter"), F.lit(1).cast("long").alias("n"))),
        F.transform(goals, lambda g: F.struct(F.concat(F.lit("facts_per_goal:"), F.size(facts_of(g)).cast("string")).alias("counter"), F.lit(1).cast("long").alias("n"))),
    )
    x = cases.where("c is not null").select(F.explode(own).alias("x")).select("x.*")
    return x.groupBy("counter").agg(F.sum("n").alias("n"))


def property_tally(cases: DataFrame, raw: str = "raw") -> DataFrame:
    """(name, n) of the properties (gates' conditions too), target types and actions of contracts 1.1."""
    from quillspark.functions.requests import BUCKETS, text_form
    from quillspark.functions.rowwise import loaded, rowwise

    def names(text):
        c = loaded(text)
        out = []
        for g in (c.get("goals") or []) if isinstance(c, dict) else []:
            gate = g.get("gate")
            facts = [p for b in BUCKETS for p in g.get(b) or []] + ([gate["when"]] if isinstance(gate, dict) and isinstance(gate.get("when"), dict) else [])
            out += [text_form(p.get("property")) for p in facts]
            out += [f"{what}:{form}" for what, form in (("type", text_form((g.get("target") or {}).get("type"))), ("action", text_form(g.get("action")))) if form]
        return [x for x in out if x]

    return cases.select(F.explode(rowwise("array<string>", names)(F.col(raw))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def first_goal_rates(cases: DataFrame) -> DataFrame:
    """Of (expected, got, schema_valid): shares parsed, valid, equal, and right in goal count, first action and first target."""
    e, g = F.try_parse_json("expected"), F.try_parse_json("got")
    size = lambda v: F.size(F.try_variant_get(v, "$.goals", "array<variant>"))
    same = lambda path: F.coalesce(F.try_variant_get(e, path, "string") == F.try_variant_get(g, path, "string"), F.lit(False))
    parsed = F.coalesce(F.schema_of_variant(g).startswith("OBJECT"), F.lit(False))
    flags = {"json_parse": parsed, "schema_valid": F.col("schema_valid"), "exact_contract": parsed & F.coalesce(F.to_json(e) == F.to_json(g), F.lit(False)), "goal_count": parsed & F.coalesce(size(e) == size(g), F.lit(False)), "first_action": parsed & same("$.goals[0].action"), "first_target": parsed & same("$.goals[0].target.name")}
    x = cases.select(F.lit(1).alias("one"), *(v.cast("int").alias(k) for k, v in flags.items()))
    return rates(x, [], {f"{k}_rate": (k, ["one"]) for k in flags}, empty=0.0, digits=6).drop("one", *flags)


def manifest_counts(rows: DataFrame, *levels: str) -> DataFrame:
    """(level columns, n): rows by every prefix of the levels, null meaning all (a rollup)."""
    return rows.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("n > 0").select(*levels, "n", F.col("g").cast("int").alias("grouping"))


def near_report(pairs: DataFrame, score: str, key: list[str], limit: int = 40) -> DataFrame:
    """The highest pairs, each key once: a report of `limit` rows."""
    best = pairs.groupBy(*key).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), *key).limit(limit)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn by the hash of a key and a seed: the same at every run and in any order."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def length_changes(old: DataFrame, new: DataFrame, key: str, length: str) -> DataFrame:
    """(key, before, after, change) of the rows that both tables hold."""
    return old.select(key, F.col(length).alias("before")).join(new.select(key, F.col(length).alias("after")), key).withColumn("change", F.col("after") - F.col("before"))


def tagged(cases: DataFrame, tags: str, *, keep: Iterable[str] = (), drop: Iterable[str] = ()) -> DataFrame:
    """The cases that hold one of the tags to keep (if any are named) and none of those to drop."""
    words = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    keep, drop = list(keep), list(drop)
    ok = ~F.arrays_overlap(listed(F.col(tags)), words(drop)) if drop else F.lit(True)
    return cases.where(ok & (F.arrays_overlap(listed(F.col(tags)), words(keep)) if keep else F.lit(True)))


def readable(text: Column, *, longest: int = 240, words: int = 5) -> Column:
    """Whether a request is short, of some words, and free of replacement characters."""
    return (F.length(text) <= longest) & (F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))) >= words) & ~F.contains(text, F.lit("�"))
