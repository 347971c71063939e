"""Written intermediate tables in the folder that all executors share, and joins that split hot keys.

A written table cuts lineage: a lost executor costs a re-read, not a recomputation. Folders are removed
when the session's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BinaryType, StringType

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, on one machine only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path, removed when the process ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_of(counts: DataFrame, key: list[str], n: str, total: int, least: int = 256) -> DataFrame | None:
    """(key, __salts) of the counted keys with over max(least, a 100,000th of total) rows, so at most 100,000; None if there is none."""
    each = max(least, -(-total // 100_000))
    if total <= each:
        return None
    many = counts.where(F.col(n) > each).select(*key, F.ceil(F.col(n) / each).cast("int").alias("__salts"))
    found = many.collect()  # bounded as said
    return counts.sparkSession.createDataFrame(found, many.schema) if found else None


def hot_keys(rows: DataFrame, *key: str, least: int = 256) -> DataFrame | None:
    """The same for the keys of rows, which are counted here."""
    return hot_of(rows.groupBy(*key).agg(F.count("*").alias("__n")), list(key), "__n", rows.count(), least)


def spread_join(many: DataFrame, one: DataFrame, key: list[str], hot: DataFrame | None, deal: list[str], how: str = "inner") -> DataFrame:
    """many joined with one by key, hot keys dealt over several tasks by a hash of the `deal` columns."""
    if hot is None:
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    salts = F.coalesce("__salts", F.lit(1))
    many = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*deal), salts).cast("int")).drop("__salts")
    one = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return many.join(one, [*key, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, keys: list, column: str) -> DataFrame:
    """df in the order of its keys with each row's number from 1, without one task for all rows.

    Sorted ranges are written with each row's place in its range; the rows before a range are added up from
    one row a range.
    """
    placed = keep(df.orderBy(*keys).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(column, F.col("__before") + inside + 1).orderBy(column).drop("__place", "__part", "__before")


def ranked_within(df: DataFrame, group: str, keys: list, column: str, few: int = 1_000_000) -> DataFrame:
    """df with each row's number from 1 within its group, in the order of the keys; a group of any size is many tasks' work."""
    every = ranked(df, [group, *keys], "__rank")
    first = every.groupBy(F.col(group).alias("__group")).agg(F.min("__rank").alias("__first"))
    first = keep(first, "group-starts")
    first = F.broadcast(first) if first.count() <= few else first
    return every.join(first, F.col(group).eqNullSafe(F.col("__group"))).select(*df.columns, (F.col("__rank") - F.col("__first") + 1).alias(column))


def _identity(rows: DataFrame, columns: list[str]) -> Column:
    """The SHA-256 of the columns' values: what stands for them where they are too wide to be sorted or sent again."""
    text = lambda c: F.col(c) if rows.schema[c].dataType in (StringType(), BinaryType()) else F.to_json(F.struct(c), {"ignoreNullFields": "false"})
    each = [F.coalesce(F.sha2(text(c).cast("binary"), 256), F.lit("null")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws(" ", *each).cast("binary"), 256))


def _kinds(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, int | None]:
    """The rows, written with the identity of their columns (__id) and a number to deal them by; and about how many distinct ones there are, None where most rows have one of their own."""
    rows = keep(rows.select("*", _identity(rows, columns).alias("__id"), F.monotonically_increasing_id().alias("__deal")), "each-rows")
    total, kinds = rows.agg(F.count("*"), F.approx_count_distinct("__id")).first()
    return rows, kinds if kinds * 2 <= total else None


def _asked(rows: DataFrame, columns: list[str], kinds: int) -> DataFrame:
    """(__id, columns) of the distinct kinds: no fewer tasks than cores, and rows of a task take a second or so."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-kinds // 5_000))
    return rows.select("__id", *columns).distinct().repartition(parts)


def _told(rows: DataFrame, told: DataFrame, few: int) -> DataFrame:
    """The rows with what is told of their kind; only identities and the columns asked for meet."""
    if told.count() <= few:
        return rows.join(F.broadcast(told), "__id")
    # what is told of a kind may be several rows, so the rows of a kind are dealt and its answers go to each part
    return spread_join(rows, told, ["__id"], hot_keys(rows, "__id"), ["__deal"])


def once_each(rows: DataFrame, columns: list[str], f: Callable[[DataFrame], DataFrame], few: int = 20_000) -> DataFrame:
    """f(rows), for an f that adds columns which follow from `columns` alone: it is asked once for each distinct value of them.

    What it says is joined back by the values' digests, nulls as equal; up to `few` answers are broadcast, more are joined
    with hot values dealt. Rows that hardly repeat are given to f as they are.
    """
    names = rows.columns
    rows, kinds = _kinds(rows, columns)
    if kinds is None:
        return f(rows.select(*names))
    told = f(_asked(rows, columns, kinds))
    made = [c for c in told.columns if c not in (*columns, "__id")]
    told = keep(told.select("__id", *made), "each-told")
    return _told(rows.drop(*made), told, few).drop("__id", "__deal")


def counted(rows: DataFrame, columns: list[str], f: Callable[[DataFrame], DataFrame], weight: str = "weight") -> DataFrame:
    """f over the distinct values of the columns, each with how many rows have it: for totals, which need no row of its own again.

    The rows meet in one exchange and nothing is joined back. f keeps the weight as a column.
    """
    kinds = keep(rows.groupBy(*columns).agg(F.count("*").alias(weight)), "counted")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-kinds.count() // 5_000))
    return f(kinds.repartition(parts))


def for_kinds(cases: DataFrame, columns: list[str], f: Callable[[DataFrame], DataFrame], few: int = 20_000) -> DataFrame:
    """f(cases), for an f that gives rows by case which follow from `columns` alone: each kind is asked once, and its rows stand for all of its cases.

    f is given `case` and the columns, and gives any number of rows with `case`, which no two cases share: a kind's is the
    digest of its values. Cases that hardly repeat are given to f as they are.
    """
    names = cases.columns
    cases, kinds = _kinds(cases, columns)
    if kinds is None:
        return f(cases.select(*names))
    told = f(_asked(cases, columns, kinds).select(F.hex("__id").alias("case"), *columns))
    made = [c for c in told.columns if c != "case"]
    told = keep(told.select(F.unhex("case").alias("__id"), *made), "kinds-told")
    return _told(cases.select("case", "__id", "__deal"), told, few).select("case", *made)
