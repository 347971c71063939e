"""Splits that keep families whole, and panels that cover tags first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hash_order(x: Column) -> Column:
    """A fixed pseudo-random order that any engine can reproduce."""
    return F.md5(x.cast("string").cast("binary"))


def grouped_split(rows: DataFrame, family: str, stratum: str | list[str], percent: int) -> DataFrame:
    """The rows with a split: whole families go to 'valid', in hashed order, until a stratum has its share.

    With several columns each combination of their values is a stratum.

    A family lies in the stratum of its largest number of rows (ties to the smaller name). Work is on
    one row a family; rows meet their family's split in one join.
    """
    columns = [stratum] if isinstance(stratum, str) else stratum
    per = rows.groupBy(family, F.struct(*columns).alias("__stratum")).agg(F.count("*").alias("n"))
    fam = per.groupBy(family).agg(F.sum("n").alias("n"), F.min_by("__stratum", F.struct(-F.col("n"), F.col("__stratum"))).alias("home"))
    w = Window.partitionBy("home").orderBy(hash_order(F.col(family)), family)
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("home"))
    placed = fam.select(family, F.when(before * 100 < total * percent, "valid").otherwise("train").alias("split"))
    return rows.join(placed, family)


def panel(rows: DataFrame, key: str, tags: str, each: int) -> DataFrame:
    """(tag, key): for each tag the first `each` rows in hashed order."""
    flat = rows.select(key, F.explode(F.array_distinct(tags)).alias("tag"))
    from quillspark.operators.draws import first_of_groups

    return first_of_groups(flat.withColumn("place", hash_order(F.col(key))), ["tag"], ["place", key], each).select("tag", key)
