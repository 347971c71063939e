"""A data source of GTFS archives: spark.read.format("gtfs").option("table", "stop_times").load(path).

The path is a zip, a folder of zips, or several separated by commas, on any file system that Arrow opens.
Each archive is a partition: a task checks its SHA-256, inflates the table's member as a stream and sends Arrow
batches. Filters on columns are applied there; filters on `feed` (the archive's name without its ending) leave
out whole archives. With `first_day` and `last_day` the tables trips, stop_times and calendar_dates hold only
what runs on those days, so a search of one day doesn't carry the rest of a timetable out of its archive.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as csv
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quillspark.sources.gtfs import COLUMNS, Feed

_COMPARED = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def archives(path: str) -> list[str]:
    """The zips of a path, in order."""
    out = []
    for one in path.split(","):
        system, place = opened(one.strip())
        info = system.get_file_info(place)
        if info.type == fs.FileType.Directory:
            head = one.strip()[: len(one.strip()) - len(place)] if one.strip().endswith(place) else ""
            out += sorted(f"{head}{f.path}" for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".zip"))
        elif info.type == fs.FileType.File:
            out.append(one.strip())
        else:
            raise FileNotFoundError(one)
    return out


def feed_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".zip")


@dataclass
class Archive(InputPartition):
    path: str


class GtfsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.table = options.get("table", "")
        if self.table not in COLUMNS:
            raise ValueError(f"no table {self.table!r} in a feed; there are {', '.join(COLUMNS)}")
        self.path, self.days = options["path"], (options.get("first_day"), options.get("last_day"))
        # one hash for a single archive, or a JSON object by feed name
        given = options.get("sha256")
        self.hashes = json.loads(given) if given and given.startswith("{") else given
        self.filters: list = []

    def pushFilters(self, filters) -> Iterator:
        known = {*COLUMNS[self.table], "feed"}
        for f in filters:
            if isinstance(f, (*_COMPARED, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        found = archives(self.path)
        for f in self.filters:
            if f.attribute == ("feed",) and not isinstance(f, IsNotNull):
                found = [p for p in found if (feed_name(p) in f.value if isinstance(f, In) else _COMPARED[type(f)](pa.scalar(feed_name(p)), pa.scalar(f.value)).as_py())]
        return [Archive(p) for p in found]

    def checked(self, raw, path: str) -> None:
        wanted = self.hashes.get(feed_name(path)) if isinstance(self.hashes, dict) else self.hashes
        if not wanted:
            return
        digest = hashlib.sha256()
        while part := raw.read(1 << 20):
            digest.update(part)
        raw.seek(0)
        if digest.hexdigest() != wanted:
            raise ValueError(f"the feed's hash is {digest.hexdigest()}")

    def rows(self, z: zipfile.ZipFile, table: str) -> Iterator[pa.RecordBatch]:
        """A member's rows as strings, with their line numbers from 1; absent columns are empty."""
        with z.open(f"{table}.txt") as member:
            header = io.TextIOWrapper(member, encoding="utf-8-sig", newline="").readline()
        if not header.strip():
            return
        names = [c.strip().strip('"') for c in header.strip().split(",")]
        at = 0
        with z.open(f"{table}.txt") as member:
            options = csv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False)
            reader = csv.open_csv(pa.PythonFile(member, "r"), csv.ReadOptions(block_size=1 << 20, column_names=names, skip_rows=1), csv.ParseOptions(newlines_in_values=False), options)
            for batch in reader:
                empty = pa.array([""] * batch.num_rows)
                columns = [batch.column(names.index(c)) if c in names else empty for c in COLUMNS[table]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(at + 1, at + 1 + batch.num_rows))], [*COLUMNS[table], "line"])
                at += batch.num_rows

    def running(self, z: zipfile.ZipFile) -> tuple[set, set] | None:
        """Services and trips that run within the days; None where all are wanted."""
        if not any(self.days):
            return None
        first, last = ((d or e).replace("-", "") for d, e in zip(self.days, ("00000000", "99999999"), strict=True))
        services, trips = set(), set()
        for b in self.rows(z, "calendar_dates"):
            services |= {s for s, d, x in zip(*(b.column(c).to_pylist() for c in ("service_id", "date", "exception_type")), strict=True) if x == "1" and first <= d <= last}
        if self.table == "stop_times":
            for b in self.rows(z, "trips"):
                trips |= {t for t, s in zip(b.column("trip_id").to_pylist(), b.column("service_id").to_pylist(), strict=True) if s in services}
        return services, trips

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system, place = opened(partition.path)
        with system.open_input_file(place) as raw:
            self.checked(raw, partition.path)
            with zipfile.ZipFile(raw) as z:
                running = self.running(z)
                for batch in self.rows(z, self.table):
                    batch = batch.append_column("feed", pa.array([feed_name(partition.path)] * batch.num_rows, pa.string()))
                    for f in self.filters:
                        x = batch.column(f.attribute[0])
                        if isinstance(f, In):
                            batch = batch.filter(pc.is_in(x, pa.array(f.value, pa.string())))
                        elif not isinstance(f, IsNotNull):
                            batch = batch.filter(_COMPARED[type(f)](x, pa.scalar(f.value, pa.string())))
                    # looked up in a set: is_in would hash all of an archive's trips again for each batch
                    if running and self.table in ("trips", "calendar_dates"):
                        batch = batch.filter(pa.array([x in running[0] for x in batch.column("service_id").to_pylist()], pa.bool_()))
                    if running and self.table == "stop_times":
                        batch = batch.filter(pa.array([x in running[1] for x in batch.column("trip_id").to_pylist()], pa.bool_()))
                    if running and self.table == "calendar_dates":
                        first, last = ((d or e).replace("-", "") for d, e in zip(self.days, ("00000000", "99999999"), strict=True))
                        batch = batch.filter(pc.and_(pc.greater_equal(batch.column("date"), first), pc.less_equal(batch.column("date"), last)))
                    if batch.num_rows:
                        yield batch


class GtfsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gtfs"

    def schema(self) -> str:
        table = self.options.get("table", "")
        if table not in COLUMNS:
            raise ValueError(f"no table {table!r} in a feed; there are {', '.join(COLUMNS)}")
        return ", ".join([*(f"{c} string" for c in COLUMNS[table]), "line long", "feed string"])

    def reader(self, schema) -> GtfsReader:
        return GtfsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters go down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GtfsSource)


def read_feed(spark: SparkSession, path: str, *, sha256: str | None = None, first: str | None = None, last: str | None = None) -> Feed:
    """The five tables of an archive, or of several with one namespace of ids; of repeated ids the last row holds.

    With `first` and `last` only what runs on those days (and the night before them counts as a day of its own).
    """
    register(spark)
    options = {k: v for k, v in {"sha256": sha256, "first_day": first, "last_day": last}.items() if v}
    keys = {"stops": ["stop_id"], "routes": ["route_id"], "trips": ["trip_id"]}
    out = {}
    for name, columns in COLUMNS.items():
        t = spark.read.format("gtfs").options(table=name, **options).load(path)
        if name in keys:
            t = t.groupBy(*keys[name]).agg(F.max_by(F.struct(*columns), F.struct("feed", "line")).alias("x")).select("x.*")
        out[name] = t.select(*columns)
    return Feed(**out)


def write_feed(feed: Feed, path: str, parts: int | None = None, each: int = 250_000) -> DataFrame:
    """Archives part-0000.zip and so on under a path that all executors share; (feed, sha256, rows) of each.

    Without `parts` there is an archive for each `each` trips and calls, four at least, so that a task's share doesn't grow.
    Trips and their calls are dealt by trip, the other tables are in each archive. A task writes one archive
    as a stream of sorted rows, under a name of its own until it is whole.
    """
    spark = feed.stops.sparkSession
    if parts is None:
        parts = max(4, -(-(feed.trips.count() + feed.stop_times.count()) // each))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    one = F.pmod(F.xxhash64("trip_id"), F.lit(parts)).cast("int")
    quoted = lambda c: F.when(F.col(c).rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    lines = None
    for at, (name, columns) in enumerate(COLUMNS.items()):
        t = getattr(feed, name)
        part = one if name in ("trips", "stop_times") else every
        x = t.select(part.alias("part"), F.lit(at).alias("table"), F.concat_ws(",", *map(quoted, columns)).alias("row"))
        lines = x if lines is None else lines.unionByName(x)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, done = list(COLUMNS), None, []
        z = member = None

        def end() -> None:
            member.close()
            for k in range(now[1] + 1, len(names)):
                z.writestr(f"{names[k]}.txt", ",".join(COLUMNS[names[k]]) + "\n")
            z.close()
            raw.close()
            with system.open_input_stream(draft) as f:
                digest = hashlib.sha256()
                while part := f.read(1 << 20):
                    digest.update(part)
            final = f"{place}/part-{now[0]:04d}.zip"
            system.move(draft, final)
            done.append((feed_name(final), digest.hexdigest(), count))

        for batch in batches:
            of, kinds, texts = batch.column("part").to_numpy(), batch.column("table").to_numpy(), batch.column("row")
            if not len(of):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (kinds[1:] != kinds[:-1])]))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
                part, table, run = int(of[start]), int(kinds[start]), texts.slice(start, stop - start).to_pylist()
                if now is None or part != now[0]:
                    if now is not None:
                        end()
                    system, place = opened(path)
                    system.create_dir(place, recursive=True)
                    draft, count = f"{place}/.part-{part:04d}-{os.urandom(4).hex()}", 0
                    raw = system.open_output_stream(draft)
                    z, now, member = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED), (part, -1), None
                if table != now[1]:
                    if member:
                        member.close()
                    for k in range(now[1] + 1, table):
                        z.writestr(f"{names[k]}.txt", ",".join(COLUMNS[names[k]]) + "\n")
                    member = z.open(f"{names[table]}.txt", "w")
                    member.write((",".join(COLUMNS[names[table]]) + "\n").encode())
                    now = (part, table)
                member.write(("\n".join(run) + "\n").encode())
                count += len(run)
        if now is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["feed", "sha256", "rows"])

    # by number: hashed, several archives would fall to one task
    dealt = lines.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "table", "row")
    made = dealt.mapInArrow(write, "feed string, sha256 string, rows long").collect()  # a row an archive
    return spark.createDataFrame(made, "feed string, sha256 string, rows long")
