"""Registration of queries with their SQL, and the inputs that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.text import normalize_text, token_set
from quillspark.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def normalized(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return documents.select(F.col(id_col).alias("id"), normalize_text(F.col("text")).alias("key"))


def token_sets(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return normalized(documents, id_col).select("id", token_set(F.col("key")).alias("tokens"))


#: SQL for the same inputs.
KEY = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"
NORM = f"norm AS (SELECT doc_id AS id, {KEY} AS key FROM documents), bnorm AS (SELECT item_id AS id, {KEY} AS key FROM benchmark)"
TOKENS = f"{NORM}, tok AS (SELECT DISTINCT id, unnest(string_split(key, ' ')) AS token FROM norm), btok AS (SELECT DISTINCT id, unnest(string_split(key, ' ')) AS token FROM bnorm), sets AS (SELECT id, token, count(*) OVER (PARTITION BY id) AS n FROM tok WHERE token <> ''), bsets AS (SELECT id, token, count(*) OVER (PARTITION BY id) AS n FROM btok WHERE token <> '')"
