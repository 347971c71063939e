"""Direct rail connections in a GTFS feed: who goes from here to there on a date, in which order.

Times are seconds after the service day's midnight and may exceed a day, so the service days D - 1 and
D are both looked at and departures dated D are kept. Wall-clock times carry no zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.text import service_seconds
from quillspark.operators.tables import ranked
from quillspark.sources.gtfs import Feed

RAIL = "2"
DAY = 86400


@dataclass(frozen=True)
class Clock:
    """A bound on a time of day in minutes: op is after, before, eq or between."""

    op: str
    minutes: int
    to: int | None = None
    inclusive: bool = True

    def holds(self, at: Column) -> Column:
        if self.op == "after":
            return at >= self.minutes if self.inclusive else at > self.minutes
        if self.op == "before":
            return at <= self.minutes if self.inclusive else at < self.minutes
        if self.op == "eq":
            return at == self.minutes
        if self.op == "between":
            return (at >= self.minutes) & (at <= self.to) if self.inclusive else (at > self.minutes) & (at < self.to)
        raise ValueError(f"no bound {self.op}")


def resolve_station(feed: Feed, name: str, cities: frozenset[str] = frozenset()) -> DataFrame:
    """Stops of that name; for a listed city also those whose name it begins."""
    stop = F.lower(F.trim("stop_name"))
    want = " ".join(name.lower().split())
    ok = stop == want
    if want in cities:
        ok = ok | stop.startswith(want + " ")
    return feed.stops.where(ok).select("stop_id", "stop_name")


def calls(feed: Feed) -> DataFrame:
    """Every call of a running rail service: service date, trip, place in the trip and times."""
    times = feed.stop_times.where("departure_time <> '' and arrival_time <> ''").select("trip_id", "stop_id", service_seconds(F.col("arrival_time")).alias("arr"), service_seconds(F.col("departure_time")).alias("dep"), F.col("stop_sequence").cast("int").alias("seq"))
    rail = feed.routes.where(F.col("route_type") == RAIL).select("route_id", "route_short_name")
    runs = feed.calendar_dates.where("exception_type = '1'").select("service_id", F.to_date("date", "yyyyMMdd").alias("service_day")).distinct()
    return feed.trips.join(rail, "route_id").join(runs, "service_id").join(times, "trip_id").select("service_day", "trip_id", "route_short_name", "stop_id", "arr", "dep", "seq")


def connections(feed: Feed, origins: DataFrame, destinations: DataFrame, date: str, *, departure: Clock | None = None, arrival: Clock | None = None, sort: str = "departure", descending: bool = False, limit: int | None = None) -> DataFrame:
    """Direct connections on a date; of a trip's qualifying destinations the first after each origin.

    Sorted by departure, arrival or duration, ties by trip, origin and destination; descending turns the
    ties as well. An arrival bound leaves out arrivals after the date.
    """
    day = F.to_date(F.lit(date))
    near = calls(feed).where(F.col("service_day").between(F.date_sub(day, 1), day))
    a = near.join(F.broadcast(origins.select("stop_id")), "stop_id", "left_semi").select("service_day", "trip_id", "route_short_name", F.col("stop_id").alias("origin"), F.col("dep"), F.col("seq").alias("from_seq"))
    b = near.join(F.broadcast(destinations.select("stop_id")), "stop_id", "left_semi").select("service_day", "trip_id", F.col("stop_id").alias("destination"), F.col("arr"), F.col("seq").alias("to_seq"))
    pairs = a.join(b, ["service_day", "trip_id"]).where("to_seq > from_seq AND arr >= dep")
    shift = F.datediff("service_day", day) * DAY
    pairs = pairs.withColumn("departs", F.col("dep") + shift).withColumn("arrives", F.col("arr") + shift).where(F.col("departs").between(0, DAY - 1))
    if departure:
        pairs = pairs.where(departure.holds(F.floor(F.col("departs") / 60)))
    if arrival:
        pairs = pairs.where((F.col("arrives") < DAY) & arrival.holds(F.floor(F.col("arrives") / 60)))
    first = F.row_number().over(Window.partitionBy("service_day", "trip_id", "from_seq").orderBy("to_seq"))
    found = pairs.withColumn("k", first).where("k = 1").withColumn("duration", F.floor((F.col("arrives") - F.col("departs")) / 60).cast("int"))
    key = {"departure": "departs", "arrival": "arrives", "duration": "duration"}[sort]
    keys = [F.desc(c) if descending else F.asc(c) for c in (key, "trip_id", "origin", "destination", "departs")]
    out = ["trip_id", "route_short_name", "origin", "destination", "departs", "arrives", "duration"]
    if limit is not None:
        found = found.orderBy(*keys).limit(limit)
    return ranked(found, keys, "rank").select(F.format_string("R%04d", "rank").alias("ref"), "trip_id", "route_short_name", "origin", "destination", "departs", "arrives", "duration")
