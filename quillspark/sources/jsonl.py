"""JSONL tables: strict scans, chat and gold rows, sinks that resume, fingerprints and job folders."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

CHAT = "messages ARRAY<STRUCT<role: STRING, content: STRING>>, category STRING, source STRING, source_split STRING, source_id STRING, source_scenario_id STRING, tags ARRAY<STRING>"
CASE = "id STRING, text STRING, contract STRING, tags ARRAY<STRING>, mandatory BOOLEAN, note STRING, equivalences ARRAY<ARRAY<STRING>>, family STRING, review_flags ARRAY<STRING>"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, value): non-blank lines, numbered from 1 within their file in one pass over it.

    Line numbers need a file's order, so files are not split; write them once and keep the number.
    """
    whole = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    return whole.where(F.trim("value") != "").select("path", (F.col("at") + 1).cast("long").alias("line_no"), "value")


def read_jsonl(spark: SparkSession, *paths: str, schema: str) -> DataFrame:
    """Rows of the files; a line that doesn't parse fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def read_existing(spark: SparkSession, patterns: list[str], schema: str) -> DataFrame:
    """Rows of all files that match any pattern, with their file; patterns without a file are skipped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in patterns:
        path = hadoop.Path(p)
        found += [x.getPath().toString() for x in (path.getFileSystem(conf).globStatus(path) or [])]
    if not found:
        return spark.createDataFrame([], T._parse_datatype_string(schema)).withColumn("file", F.lit(None).cast("string"))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(sorted(found)).withColumn("file", F.input_file_name())


def message(messages: Column, role: str, last: bool = False) -> Column:
    """Content of the first (or last) message of a role."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(own, F.lit(-1 if last else 1))["content"]


def cases(rows: DataFrame) -> DataFrame:
    """Chat rows or gold rows as cases: id, text, contract (JSON text or null), tags, family.

    A chat row's text is its first user message and its contract the last assistant message; an
    assistant message that is no JSON object gives a null contract. A row without an id takes its
    source id, or 16 digits of the text's digest.
    """
    has = set(rows.columns)
    col = lambda n, t="string": F.col(n) if n in has else F.lit(None).cast(t)
    text, contract = col("text"), col("contract")
    if "messages" in has:
        text = F.coalesce(text, message(F.col("messages"), "user"))
        contract = F.coalesce(contract, message(F.col("messages"), "assistant", last=True))
    checked = F.when(F.try_parse_json(contract).isNotNull() & F.ltrim(contract).startswith("{"), contract)
    return rows.select(
        F.coalesce(col("id"), col("source_id"), F.substring(F.sha2(text, 256), 1, 16)).alias("id"),
        text.alias("text"),
        checked.alias("contract"),
        F.coalesce(col("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(col("family"), col("source_scenario_id"), col("source_id")).alias("family"),
    )


def keyed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key; the last in order holds."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order)).alias("r")).select("r.*")


def as_chat(text: Column, contract: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("assistant").alias("role"), contract.alias("content")))


def write_new(df: DataFrame, path: str) -> None:
    """Writes JSONL; fails where the path exists."""
    df.write.mode("errorifexists").json(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the sink lacks and returns how many the sink then holds.

    Run again after a failure, it goes on where it stopped; a key is written once.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = df.dropDuplicates([key])
    if exists:
        new = new.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti").select(*df.columns)
    new.write.mode("append").json(path)
    return spark.read.schema(df.schema).json(path).count()


def write_report(df: DataFrame, folder: str) -> str:
    """A report as JSON, CSV and a Markdown table (returned); reports are a few rows."""
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.collect()]
    return "\n".join(lines) + "\n"


def fingerprint(path: str | Path) -> str:
    """SHA-256 of a file with CRLF read as LF, so that checkouts agree."""
    return hashlib.sha256(Path(path).read_bytes().replace(b"\r\n", b"\n")).hexdigest()


def frozen(expected: dict[str, str]) -> None:
    """Stops where a file's fingerprint isn't the expected one."""
    drift = sorted(p for p, h in expected.items() if fingerprint(p) != h)
    if drift:
        raise ValueError(f"changed since they were frozen: {', '.join(drift)}")


def table_fingerprint(df: DataFrame) -> Column | str:
    """A digest of a table's rows in any order: the row hashes are added up, so no row order is needed."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    halves = [F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31)]
    got = df.agg(F.count("*").alias("n"), *(F.sum(h).alias(f"h{i}") for i, h in enumerate(halves))).first()
    return hashlib.sha256(repr(tuple(got)).encode()).hexdigest()


def job_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Jobs dropped into a folder as JSON files, each read once; they are data and never executed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.job").json(folder).withColumn("job", F.input_file_name())
