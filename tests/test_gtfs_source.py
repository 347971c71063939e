"""The GTFS data source: reading in tasks, filters, days, hashes, and archives written and read back."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_stateful import feed_zip

from quillspark.operators.timetable import calls
from quillspark.sources.gtfs import COLUMNS, Feed, read_zip
from quillspark.sources.gtfs_source import GtfsReader, read_feed, register, write_feed


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_are_those_of_the_driver_side_reader(spark, tmp_path):
    path = feed_zip(tmp_path / "feed.zip")
    digest = hashlib.sha256((tmp_path / "feed.zip").read_bytes()).hexdigest()
    a, b = read_zip(spark, path), read_feed(spark, path, sha256=digest)
    for name, columns in COLUMNS.items():
        assert rows(getattr(a, name)) == rows(getattr(b, name)) and getattr(b, name).columns == columns
    with pytest.raises(Exception, match="hash is"):
        read_feed(spark, path, sha256="0" * 64).stops.collect()
    with pytest.raises(Exception, match="no table"):
        spark.read.format("gtfs").option("table", "fares").load(path)


def test_filters_go_down_and_feeds_are_left_out(spark, tmp_path):
    for name in ("a", "b", "c"):
        feed_zip(tmp_path / f"{name}.zip")
    register(spark)
    t = spark.read.format("gtfs").option("table", "stop_times").load(str(tmp_path))
    assert t.count() == 33 and t.rdd.getNumPartitions() == 3
    some = t.where("feed in ('a', 'c') and stop_id = 'A' and departure_time >= '08:10:00'")
    assert some.rdd.getNumPartitions() == 2
    assert rows(some.select("feed", "trip_id")) == [(f, t) for f in "ac" for t in ("N", "T2", "T3", "T4")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan, plan
    assert t.where(F.length("trip_id") == 1).count() == 6  # stays with Spark
    assert [r.line for r in t.where("feed = 'b'").orderBy("line").collect()] == list(range(1, 12))


def test_days_leave_out_what_does_not_run(spark, tmp_path):
    path = feed_zip(tmp_path / "feed.zip")
    only = read_feed(spark, path, first="2026-03-01", last="2026-03-01")
    assert rows(only.trips.select("trip_id")) == [("N",)] and rows(only.stop_times.select("trip_id").distinct()) == [("N",)]
    assert rows(only.calendar_dates) == [("L", "20260301", "1")]
    assert only.stops.count() == 4
    none = read_feed(spark, path, first="2027-01-01")
    assert none.stop_times.count() == 0 and calls(none).count() == 0


def test_archives_come_back_as_written(spark, tmp_path):
    stops = spark.createDataFrame([(f"S{i}", 'Sankt "Ö", Nord' if i == 3 else f"stop {i}") for i in range(9)], "stop_id string, stop_name string")
    routes = spark.createDataFrame([("R", "RE", "2"), ("B", "bus", "3")], "route_id string, route_short_name string, route_type string")
    trips = spark.range(40).select(F.concat(F.lit("T"), "id").alias("trip_id"), F.when(F.col("id") % 4 == 0, "B").otherwise("R").alias("route_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("service_id"))
    times = trips.select("trip_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n")).select("trip_id", F.format_string("08:%02d:00", "n").alias("arrival_time"), F.format_string("08:%02d:30", "n").alias("departure_time"), F.concat(F.lit("S"), "n").alias("stop_id"), F.col("n").cast("string").alias("stop_sequence"))
    days = spark.createDataFrame([(f"s{i}", "20260302", "1") for i in range(3)], "service_id string, date string, exception_type string")
    feed = Feed(stops, routes, trips, times, days)
    made = write_feed(feed, str(tmp_path / "out"), 5)
    assert made.count() == 5 and made.agg(F.sum("rows")).first()[0] == 40 + 160 + 5 * (9 + 2 + 3)
    import json

    back = read_feed(spark, str(tmp_path / "out"), sha256=json.dumps({r.feed: r.sha256 for r in made.collect()}))
    for name in COLUMNS:
        want = rows(getattr(feed, name))
        assert rows(getattr(back, name).distinct()) == sorted(set(want)), name
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-{k:04d}.zip" for k in range(5)]
    # without a number the archives grow with the trips and calls, and none is without rows of its own
    many = write_feed(feed, str(tmp_path / "many"), each=25).collect()
    assert len(many) == 8 and sum(r.rows for r in many) == 40 + 160 + 8 * (9 + 2 + 3)
    assert rows(read_feed(spark, str(tmp_path / "many")).stop_times) == rows(times)


def test_a_member_without_rows_or_columns(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("stops.txt", "stop_id\nA\nB\n")
        z.writestr("trips.txt", "trip_id,route_id,service_id\n")
        z.writestr("routes.txt", "")
    read = lambda t: [tuple(r.values()) for p in GtfsReader({"table": t, "path": str(tmp_path)}).partitions() for b in GtfsReader({"table": t, "path": str(tmp_path)}).read(p) for r in b.to_pylist()]
    assert read("stops") == [("A", "", 1, "x"), ("B", "", 2, "x")] and read("trips") == [] and read("routes") == []
