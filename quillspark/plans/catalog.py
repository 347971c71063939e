"""The registered queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import contracts, conversations, corpus, curation, relational, requests, stateful, travel  # noqa: F401  they register their queries
from quillspark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar benchmark item of each document."""
    return QUERIES["nearest_prior"](spark, sf_dir)
