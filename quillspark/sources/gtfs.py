"""GTFS feeds: five tables from a zip, or from data frames of the same columns."""

from __future__ import annotations

import hashlib
import io
import zipfile
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: The columns that are read of each table.
COLUMNS = {
    "stops": ["stop_id", "stop_name"],
    "routes": ["route_id", "route_short_name", "route_type"],
    "trips": ["trip_id", "route_id", "service_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}


@dataclass(frozen=True)
class Feed:
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    calendar_dates: DataFrame


def read_zip(spark: SparkSession, path: str, expected_sha256: str | None = None) -> Feed:
    """A feed of a zip on the driver (a snapshot of some MB); the archive's hash is checked first.

    Of repeated ids the last row holds, as in a keyed load.
    """
    with open(path, "rb") as f:
        raw = f.read()
    found = hashlib.sha256(raw).hexdigest()
    if expected_sha256 and found != expected_sha256:
        raise ValueError(f"the feed's hash is {found}")
    keys = {"stops": ["stop_id"], "routes": ["route_id"], "trips": ["trip_id"]}
    out = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name, columns in COLUMNS.items():
            table = pd.read_csv(io.BytesIO(z.read(f"{name}.txt")), dtype=str, keep_default_na=False, encoding="utf-8-sig")[columns]
            if name in keys:
                table = table.drop_duplicates(keys[name], keep="last")
            out[name] = spark.createDataFrame(table, ", ".join(f"{c} string" for c in columns))
    return Feed(**out)
