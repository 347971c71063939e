"""Timetable queries: searches of many requests, what a replay of them counts, and a feed through its archives.

Nations are stops, orders are trips over the nations of their line items' suppliers, regions are routes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.text import plain
from quillspark.operators.tables import folder
from quillspark.operators.timetable import calls
from quillspark.operators.travel import replay_flags, search_requests, slice_counters
from quillspark.plans.base import query
from quillspark.sources.gtfs import Feed
from quillspark.sources.gtfs_source import read_feed, write_feed

DAYS = ("2026-03-01", "2026-03-02")


def feed_of(t) -> Feed:
    stops = t("nation").select(F.col("n_nationkey").cast("string").alias("stop_id"), F.col("n_name").alias("stop_name"))
    routes = t("region").select(F.col("r_regionkey").cast("string").alias("route_id"), F.col("r_name").alias("route_short_name"), F.when(F.col("r_regionkey") < 4, "2").otherwise("3").alias("route_type"))
    trips = t("orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), (F.col("o_custkey") % 5).cast("string").alias("route_id"), (F.col("o_orderkey") % 4).cast("string").alias("service_id"))
    line = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    second = F.col("l_orderkey") % 24 * 3600 + F.col("l_linenumber") * 1200
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    times = line.select(F.col("l_orderkey").cast("string").alias("trip_id"), clock.alias("arrival_time"), clock.alias("departure_time"), F.col("s_nationkey").cast("string").alias("stop_id"), F.col("l_linenumber").cast("string").alias("stop_sequence"))
    days = t("region").select((F.col("r_regionkey") % 4).cast("string").alias("service_id"), F.explode(F.array(*(F.lit(d.replace("-", "")) for d in DAYS))).alias("date"), F.lit("1").alias("exception_type")).distinct()
    return Feed(stops, routes, trips, times, days)


_CALLS = "c AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT trip, seq, s_nationkey AS stop, (trip % 24) * 3600 + seq * 1200 AS sec, o_custkey % 5 AS route FROM c JOIN supplier ON s_suppkey = s JOIN orders ON o_orderkey = trip WHERE o_custkey % 5 < 4)"
_SEARCH = f"""{_CALLS}, q AS (SELECT c_custkey AS case_id, c_nationkey AS origin, (c_nationkey + 1 + c_custkey % 7) % 25 AS destination, (c_custkey % 23) * 60 AS leave_from, (c_custkey % 23) * 60 + 59 + c_custkey % 61 AS leave_to, CASE WHEN c_custkey % 4 = 0 THEN 1200 END AS come_to, CASE WHEN c_custkey % 3 = 0 THEN 40 END AS longest, 1 + c_custkey % 5 AS wanted, CASE c_custkey % 3 WHEN 0 THEN 'departure_time' WHEN 1 THEN 'arrival_time' ELSE 'duration' END AS sort, c_custkey % 2 = 0 AS down FROM customer),
m AS (SELECT q.*, a.trip, a.seq, a.sec + off AS departs, b.sec + off AS arrives, row_number() OVER (PARTITION BY case_id, a.trip, off, a.seq ORDER BY b.seq) AS first FROM q JOIN k a ON a.stop = q.origin JOIN k b ON b.trip = a.trip AND b.stop = q.destination AND b.seq > a.seq, (SELECT unnest([-86400, 0]) AS off)
 WHERE a.sec + off BETWEEN leave_from * 60 AND least(leave_to, 1439) * 60 + 59 AND (come_to IS NULL OR (b.sec + off < 86400 AND (b.sec + off) // 60 <= come_to)) AND (longest IS NULL OR (b.sec - a.sec) // 60 <= longest)),
f AS (SELECT *, (arrives - departs) // 60 AS duration FROM m WHERE first = 1), g AS (SELECT *, CASE sort WHEN 'arrival_time' THEN arrives WHEN 'duration' THEN duration ELSE departs END AS sk FROM f),
r AS (SELECT *, CASE WHEN down THEN row_number() OVER (PARTITION BY case_id ORDER BY sk DESC, trip::VARCHAR DESC, origin::VARCHAR DESC, destination::VARCHAR DESC, departs DESC) ELSE row_number() OVER (PARTITION BY case_id ORDER BY sk, trip::VARCHAR, origin::VARCHAR, destination::VARCHAR, departs) END AS rank FROM g)"""


def requests_of(t) -> DataFrame:
    """A search for each customer: from its nation to another, in an hour or two of the second day."""
    c = F.col("c_custkey")
    base = t("customer").select(c.alias("case"), F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") + 1 + c % 7) % 25).alias("b"))
    name = t("nation").select("n_nationkey", plain(F.col("n_name")).alias("name"))
    named = base.join(name.select(F.col("n_nationkey").alias("a"), F.col("name").alias("origin")), "a").join(name.select(F.col("n_nationkey").cast("long").alias("b"), F.col("name").alias("destination")), "b")
    c = F.col("case")
    first = (c % 23 * 60).cast("int")
    return named.select("case", "origin", "destination", F.to_date(F.lit(DAYS[1])).alias("day"), first.alias("leave_from"), (first + 59 + c % 61).cast("int").alias("leave_to"), F.lit(None).cast("int").alias("come_from"), F.when(c % 4 == 0, 1200).alias("come_to"), F.when(c % 3 == 0, 40).alias("longest"), (1 + c % 5).cast("int").alias("wanted"), F.when(c % 3 == 0, "departure_time").when(c % 3 == 1, "arrival_time").otherwise("duration").alias("sort"), (c % 2 == 0).alias("down"))


@query("train_search", f"WITH {_SEARCH} SELECT case_id AS c_custkey, printf('R%04d', rank) AS ref, trip::VARCHAR AS trip_id, departs::BIGINT AS departs, arrives::BIGINT AS arrives, duration::INT AS duration FROM r WHERE rank <= wanted")
def _(t):
    found = search_requests(requests_of(t), feed_of(t))[2]
    return found.select(F.col("case").alias("c_custkey"), "ref", "trip_id", F.col("departs").cast("long").alias("departs"), F.col("arrives").cast("long").alias("arrives"), "duration")


@query("train_slice_counters", f"""WITH {_SEARCH}, n AS (SELECT case_id, count(*) AS n FROM r GROUP BY 1), x AS (SELECT q.*, coalesce(n, 0) AS n, case_id % 11 <> 0 AS called, case_id % 13 <> 0 AS gold_called, case_id % 17 = 0 AS hold FROM q LEFT JOIN n USING (case_id)),
y AS (SELECT *, (called AND hold)::INT + (called AND gold_called AND case_id % 6 = 0)::INT + (called AND gold_called AND case_id % 10 = 0)::INT AS flags, CASE WHEN NOT called THEN 'HOLD' WHEN n > 0 OR case_id % 5 = 0 THEN 'READY_RESULTS' ELSE 'HOLD_INCOMPLETE_COVERAGE' END AS status FROM x)
SELECT count(*) AS cases, count(*) FILTER (WHERE called) AS provider_called, count(*) FILTER (WHERE gold_called) AS gold_provider_called, count(*) FILTER (WHERE flags > 0 OR (called AND NOT gold_called)) AS material_flagged_for_review, count(*) FILTER (WHERE gold_called AND NOT called) AS false_hold_against_agent_gold, count(*) FILTER (WHERE called AND hold) AS called_when_explicit_no_call_expected,
count(*) FILTER (WHERE case_id % 6 <> 0) AS empty_optional_fields_equivalent, count(*) FILTER (WHERE case_id % 19 <> 0) AS json_valid, count(*) FILTER (WHERE case_id % 19 <> 0 AND case_id % 7 <> 0) AS schema_valid, count(*) FILTER (WHERE case_id % 6 <> 0 AND case_id % 10 <> 0) AS canonical_exact_legacy, 0::BIGINT AS consequential_permission_true,
count(*) FILTER (WHERE status = 'READY_RESULTS') AS "status_READY_RESULTS", count(*) FILTER (WHERE status = 'HOLD') AS "status_HOLD", count(*) FILTER (WHERE status = 'HOLD_INCOMPLETE_COVERAGE') AS "status_HOLD_INCOMPLETE_COVERAGE", 0::BIGINT AS "status_NO_ACTION" FROM y""")
def _(t):
    """Searches of candidates against gold requests: some are held, some ask for other hours or fewer results."""
    requests = requests_of(t)
    found = search_requests(requests, feed_of(t))[2].groupBy("case").agg(F.count("*").alias("n"))
    c = F.col("case")
    called, gold, direct = c % 11 != 0, c % 13 != 0, c % 5 == 0
    parts = lambda leave, limit: F.struct("origin", "destination", F.col("day").alias("travel_date"), F.struct(leave.alias("from"), "leave_to", "come_to").alias("time_constraints"), direct.alias("direct_only"), F.lit(None).cast("string").alias("train_category"), F.col("longest").alias("max_duration_minutes"), limit.alias("limit"), F.struct("sort", "down").alias("sort"))
    mine, theirs = parts(F.col("leave_from"), F.col("wanted")), parts(F.col("leave_from") + F.when(c % 6 == 0, 1).otherwise(0), F.col("wanted") + F.when(c % 10 == 0, 1).otherwise(0))
    status = F.when(~called, "HOLD").when(F.col("n").isNotNull() | direct, "READY_RESULTS").otherwise("HOLD_INCOMPLETE_COVERAGE")
    cases = requests.join(found, "case", "left").select("case", F.when(c % 17 == 0, "HOLD_MISSING_INFORMATION").otherwise("READY_RESULTS").alias("expected"), called.alias("called"), gold.alias("gold_called"), F.when(called, mine).alias("request"), F.when(gold, theirs).alias("gold_request"), status.alias("status"), (c % 19 != 0).alias("json_valid"), ((c % 19 != 0) & (c % 7 != 0)).alias("schema_valid"), ((c % 6 != 0) & (c % 10 != 0)).alias("equal"), (c % 6 != 0).alias("equal_without_empty"), F.lit(False).alias("permitted"))
    return slice_counters(replay_flags(cases))


@query("feed_calls", f"WITH {_CALLS} SELECT r_name AS route, printf('2026-03-%02d', day) AS service_day, count(*) AS calls, count(DISTINCT trip) AS trips, min(sec)::BIGINT AS first, max(sec)::BIGINT AS last FROM k JOIN region ON r_regionkey = route, (SELECT unnest([1, 2]) AS day) WHERE day = 2 GROUP BY 1, 2")
def _(t):
    """The feed is written as archives and read back by the data source, one day of it."""
    feed = feed_of(t)
    path = folder(feed.stops.sparkSession, "feed")
    archives = write_feed(feed, path)
    back = read_feed(feed.stops.sparkSession, path, sha256="{" + ", ".join(f'"{r.feed}": "{r.sha256}"' for r in archives.collect()) + "}", first=DAYS[1], last=DAYS[1])
    return calls(back).groupBy(F.col("route_short_name").alias("route"), F.col("service_day").cast("string").alias("service_day")).agg(F.count("*").alias("calls"), F.countDistinct("trip_id").alias("trips"), F.min("dep").cast("long").alias("first"), F.max("dep").cast("long").alias("last"))
