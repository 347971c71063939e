"""As-of joins and running values over keys of any length: a hot key is many tasks' work.

Rows are sorted into ranges by key and order and written with their range's number. Within a range a window
does the work; what a range takes over from those before it is one row a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.operators.tables import keep


def ranges(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The rows, written, with `__range`: numbers that rise with (by, order)."""
    sorted_ = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    return keep(sorted_.withColumn("__range", F.spark_partition_id()), name)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: list[str], values: list[str]) -> DataFrame:
    """left with `found`: the values (a struct) of the latest row of right before it with its key; null if there is none.

    `at` are columns of both sides; a right row at the left row's place counts as after it. Of right rows at one
    place any may be taken. Null keys are a key. No row of left is lost or doubled.
    """
    cols = left.columns
    l_ = left.select(*by, *at, F.lit(0).alias("__side"), F.struct(*cols).alias("__left"), F.lit(None).alias("__value"))
    r_ = right.select(*by, *at, F.lit(1).alias("__side"), F.lit(None).alias("__left"), F.struct(*values).alias("__value"))
    x = ranges(l_.unionByName(r_), by, [*at, "__side"], "as-of")
    inside = Window.partitionBy("__range", *by).orderBy(*at, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = x.groupBy("__range").agg(F.max_by(F.struct(*by, "__value"), F.when(F.col("__side") == 1, F.struct(*by, *at))).alias("l"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = lasts.select("__range", F.last("l", ignorenulls=True).over(before).alias("__carried"))
    filled = x.withColumn("__own", F.last("__value", ignorenulls=True).over(inside)).where("__side = 0").join(F.broadcast(carried), "__range", "left")
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__carried.{b}"))
    found = F.coalesce("__own", F.when(F.col("__carried").isNotNull() & same, F.col("__carried.__value")))
    return filled.select("__left.*", found.alias("found"))


def running_min(rows: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows with the least value of their key so far, their own included; nulls don't count."""
    x = ranges(rows, by, order, "running")
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # only a range's first and last keys reach over its ends, so what is carried is a row a range and key there
    ends = x.groupBy("__range").agg(F.min(F.struct(*by)).alias("a"), F.max(F.struct(*by)).alias("b"))
    per = x.join(F.broadcast(ends), "__range").where(F.struct(*by).eqNullSafe(F.col("a")) | F.struct(*by).eqNullSafe(F.col("b"))).groupBy("__range", *by).agg(F.min(value).alias("__least"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select("__range", *(F.col(b).alias(f"__{b}") for b in by), F.min("__least").over(before).alias("__before")).where("__before is not null")
    same = F.col("__range") == F.col("__r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    joined = x.join(F.broadcast(carried.withColumnRenamed("__range", "__r")), same, "left")
    return joined.select(*rows.columns, F.least(F.min(value).over(inside), "__before").alias(out))
