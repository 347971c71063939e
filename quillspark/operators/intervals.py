"""Joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def interval_join(spans: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, at: str, width: int) -> DataFrame:
    """Rows of both sides with equal keys where low <= at <= high.

    Points fall in buckets of `width`, an interval in each bucket that it touches; buckets are part of the
    key, so an interval meets only points near it and a key with many points is many keys. An interval takes
    (high - low) / width + 2 rows at most: choose the width near the usual length. Empty intervals and nulls
    meet nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    touched = spans.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    met = touched.join(points.withColumn("__bucket", bucket(at)), [*keys, "__bucket"])
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("__bucket")
