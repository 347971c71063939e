"""Cleaning of labelled prompts in one pass: what is kept, what is quarantined, and how many of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from quillspark.operators.components import components
from quillspark.operators.tables import folder, hot_keys, keep, spread_join


@dataclass(frozen=True)
class Cleaned:
    kept: DataFrame
    quarantined: DataFrame
    counters: dict[str, int]


def clean_rows(rows: DataFrame, *, key: str, label: str, family: str, order: str) -> Cleaned:
    """Rows with one label a key are kept once, all rows of a key with several labels are quarantined.

    Families that share a key are one family before anything is dropped, so a split by family can't part
    them; it is named by its smallest member, digested. Of a key's rows the first in the given order is kept.
    Rows go by the key's facts (least and greatest label, first row) in one join that spreads hot keys; both
    outputs and the counters come of its one write. Null labels are a label of their own, null keys are a key.
    """
    x = rows.withColumns({"__key": F.struct(F.col(key).alias("k")), "__label": F.struct(F.col(label).alias("l"))})
    x = keep(x.withColumns({"__key": F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(key).isNull()), "__label": F.sha2(F.coalesce(F.to_json("__label"), F.lit("")), 256), "__row": F.monotonically_increasing_id()}), "clean-rows")
    facts = x.groupBy("__key", key).agg(F.min("__label").alias("__low"), F.max("__label").alias("__high"), F.min_by("__row", F.struct(order, "__row")).alias("__first"), F.min(family).alias("__family"), F.count("*").alias("__n"))
    facts = keep(facts.drop(key), "clean-facts")
    edges = x.select("__key", F.col(family).alias("b")).distinct().join(facts.select("__key", F.col("__family").alias("a")), "__key").where("a <> b").select("a", "b")
    roots = components(edges, keep)
    conflict = F.col("__low") != F.col("__high")
    verdict = F.when(conflict, "quarantined").when(F.col("__row") == F.col("__first"), "kept").otherwise("duplicate")
    judged = spread_join(x, facts.drop("__family"), ["__key"], hot_keys(x, "__key"), ["__row"]).withColumn("verdict", verdict)
    named = judged.join(roots.withColumnRenamed("node", family), family, "left")
    root = F.concat(F.lit("family-"), F.substring(F.sha2(F.coalesce("component", F.col(family)).cast("string").cast("binary"), 256), 1, 24))
    seen = Observation("clean-rows")
    first = F.col("__row") == F.col("__first")
    counted = named.observe(
        seen,
        F.count("*").alias("input_rows"),
        F.count_if(F.col("verdict") == "duplicate").alias("duplicate_rows_removed"),
        F.count_if(conflict & first).alias("conflicting_prompts"),
        F.count_if(F.col("verdict") == "quarantined").alias("conflicting_rows_quarantined"),
        F.count_if(F.col("verdict") == "kept").alias("unique_rows"),
    )
    path = folder(rows.sparkSession, "cleaned")
    out = counted.where("verdict <> 'duplicate'").select(*rows.columns, root.alias("root"), "verdict")
    out.write.partitionBy("verdict").parquet(path)
    written = rows.sparkSession.read.schema(out.schema).parquet(path)
    one = lambda v: written.where(F.col("verdict") == v).drop("verdict")
    return Cleaned(one("kept"), one("quarantined"), {k: int(v or 0) for k, v in seen.get.items()})
