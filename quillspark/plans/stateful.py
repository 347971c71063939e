"""Queries that SQL can't express: strict extraction, dialogue state and the timetable."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.strictjson import extract_json
from quillspark.functions.text import text_key
from quillspark.operators.timetable import Clock, connections
from quillspark.plans.base import query
from quillspark.sources.gtfs import Feed
from quillspark.streaming.dialogue import replay


@query("json_extract_strict", "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN replace(props, ' ', '') END AS json, CASE WHEN event_id % 5 = 0 THEN 'trailing_text' WHEN event_id % 7 = 0 THEN 'second_object' END AS code FROM events")
def _(t):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit(" trailing"))).when(F.col("event_id") % 7 == 0, F.concat("props", "props")).otherwise(F.col("props"))
    return t("events").select("event_id", extract_json(raw).alias("x")).select("event_id", "x.json", "x.code")


@query("text_key")
def _(t):
    return t("documents").select("doc_id", text_key(F.col("text")).alias("key"))


@query("dialogue_state")
def _(t):
    kind = F.when(F.col("turn") == 0, "open").when(F.col("role") == "assistant", "confirm").when(F.length("text") % 11 == 0, "cancel").otherwise("update")
    slots = F.to_json(F.create_map(F.concat(F.lit("slot"), (F.length("text") % 3).cast("string")), F.substring("text", 1, 12)))
    return replay(t("conversations").select(F.col("conv_id").cast("string").alias("conversation"), "turn", kind.alias("operation"), F.lit("find").alias("action"), slots.alias("slots")))


@query("timetable_search", """WITH c AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT trip, seq, s_nationkey AS stop, (trip % 24) * 3600 + seq * 1200 AS sec FROM c JOIN supplier ON s_suppkey = s),
d AS (SELECT k.*, o.o_custkey % 5 AS route, off FROM k JOIN orders o ON o_orderkey = trip, (SELECT unnest([-86400, 0]) AS off)), p AS (SELECT a.trip, a.route, a.off, a.seq, a.stop AS origin, b.stop AS destination, a.sec + a.off AS departs, b.sec + a.off AS arrives, row_number() OVER (PARTITION BY a.trip, a.off, a.seq ORDER BY b.seq) AS rn FROM d a JOIN d b ON a.trip = b.trip AND a.off = b.off AND b.seq > a.seq AND b.sec >= a.sec WHERE a.stop % 2 = 0 AND b.stop % 2 = 1 AND a.sec + a.off BETWEEN 3600 AND 86399),
f AS (SELECT trip::VARCHAR AS trip_id, r_name AS route_short_name, origin::VARCHAR AS origin, destination::VARCHAR AS destination, departs::INT AS departs, arrives::INT AS arrives, ((arrives - departs) // 60)::INT AS duration FROM p JOIN region ON r_regionkey = route WHERE rn = 1), n AS (SELECT *, row_number() OVER (ORDER BY duration, trip_id, origin, destination, departs) AS i FROM f) SELECT printf('R%04d', i) AS ref, * EXCLUDE (i) FROM n WHERE i <= 50""")
def _(t):
    """Each nation is a stop, each order a trip over the nations of its line items' suppliers; the 50 shortest rides."""
    stops = t("nation").select(F.col("n_nationkey").cast("string").alias("stop_id"), F.col("n_name").alias("stop_name"))
    routes = t("region").select(F.col("r_regionkey").cast("string").alias("route_id"), F.col("r_name").alias("route_short_name"), F.lit("2").alias("route_type"))
    trips = t("orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), (F.col("o_custkey") % 5).cast("string").alias("route_id"), (F.col("o_orderkey") % 4).cast("string").alias("service_id"))
    line = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    second = F.col("l_orderkey") % 24 * 3600 + F.col("l_linenumber") * 1200
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    calls = line.select(F.col("l_orderkey").cast("string").alias("trip_id"), clock.alias("arrival_time"), clock.alias("departure_time"), F.col("s_nationkey").cast("string").alias("stop_id"), F.col("l_linenumber").cast("string").alias("stop_sequence"))
    days = t("region").sparkSession.createDataFrame([(str(s), d, "1") for s in range(4) for d in ("20260301", "20260302")], "service_id string, date string, exception_type string")
    feed = Feed(stops, routes, trips, calls, days)
    return connections(feed, stops.where("stop_id % 2 = 0"), stops.where("stop_id % 2 = 1"), "2026-03-02", departure=Clock("after", 60), sort="duration", limit=50)
