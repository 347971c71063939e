"""Written intermediate tables, in the folder that all executors share.

Also keys for rows, the planner's estimates, and how files are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.operators.tables import folder, hot_keys, hot_of, keep, spread_join  # noqa: F401  the operators use them from here


def scan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: the files' bytes for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets(df: DataFrame, each: int, least: int = 8) -> int:
    """How many groups of about `each` bytes of input there are; grows with the input."""
    return max(least, min(-(-scan_bytes(df) // each), 1 << 20))


def plain_scan(df: DataFrame) -> bool:
    """Whether df only filters and projects the rows of one Parquet table, always alike."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.deterministic():
        kind = plan.getClass().getSimpleName()
        if kind == "LogicalRelation":
            relation = plan.relation()
            return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"
        if kind not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().apply(0)
    return False


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a key of its own for each row, the same at every reading, also where ids are null or repeat.

    Rows of a Parquet table go by their file (a hash of its path; two of a million files share one with
    a chance of 3e-8) and their place in it. Anything else is written first.
    """
    if plain_scan(df):
        return df.withColumn(column, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    return keep(df.withColumn(column, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), name)


def same_splits(spark: SparkSession) -> None:
    """From now on this session cuts files alike, whatever number of executors it has at a time."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
