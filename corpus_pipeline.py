"""The corpus pipeline: each stage's result is written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the
assignment of each row to a shard. Texts are shuffled only where their place changes (mixing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import shared
from quillspark.llm.curriculum import mix
from quillspark.llm.decontaminate import contamination
from quillspark.llm.packing import shard
from quillspark.llm.queries import held_out
from quillspark.llm.rules import quality_filter
from quillspark.llm.setsketch import near_duplicates
from quillspark.session import ship

#: Row keys that may be broadcast; beyond it the join shuffles.
FEW = 1_000_000
#: Names that no table of documents has.
ROW, PLACE = "__pipeline_row", "__pipeline_place"


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= FEW else keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    ship(spark)
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(4, 2))


def _without(docs: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """docs but for the rows whose keys are in gone."""
    return docs.join(_small(gone), ROW, "left_anti").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, one of its smallest id, nulls last; so do texts without words."""
    ship(spark)
    rows = shared.numbered(docs, ROW, "dedup-rows")
    named = rows.withColumn(PLACE, F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col(ROW).alias("row")))
    found = near_duplicates(named, id_col=PLACE, percent=80)
    return _without(rows, shared.keep(found.where("not kept").select(F.col(f"{PLACE}.row").alias(ROW)), "dedup"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, up to a fifth of its words edited, go; ids play no part."""
    ship(spark)
    rows = shared.numbered(docs, ROW, "decontaminate-rows")
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    return _without(rows, shared.keep(found.where("contaminated").select(ROW), "decontaminate"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document, whole, range-sorted by training position; others go.

    A pass that the mix takes in part is one a source, at its target's end, and stays whole. Rows without
    words take nothing and go.
    """
    ship(spark)
    rows = shared.numbered(docs, ROW, "mixing-rows")
    passes = mix(rows, id_col=ROW).select(ROW, F.explode("positions").alias(PLACE))
    out = rows.join(passes, ROW).repartitionByRange(PLACE, ROW).sortWithinPartitions(PLACE, ROW)
    return out.select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shard(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: SQL expresses neither the classifier nor the sketches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
