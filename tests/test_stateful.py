import hashlib
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.functions.strictjson import extract, extract_json
from quillspark.functions.text import clock_minutes, clock_text, next_weekday, normalize_text, service_seconds, text_key
from quillspark.operators.components import components
from quillspark.operators.similarity import similar_across, similar_pairs
from quillspark.operators.tables import keep
from quillspark.operators.timetable import Clock, connections, resolve_station
from quillspark.sources.gtfs import read_zip
from quillspark.streaming.dialogue import Draft, follow, missing_slots, replay, step


@pytest.mark.parametrize(
    ("raw", "json_text", "code"),
    [
        (None, None, "empty"),
        ("  ", None, "empty"),
        ("no braces", None, "no_object"),
        ('{"b": 1, "a": "}"}', '{"a":"}","b":1}', None),
        ('```json\n{"a": [1, {"x": "\\""}]}\n```', '{"a":[1,{"x":"\\""}]}', None),
        ('text {"a": 1}', '{"a":1}', None),
        ('{"a": 1', None, "truncated"),
        ('{"a": 1} more', None, "trailing_text"),
        ('{"a": 1} {"a": 2}', None, "second_object"),
        ('{"a": 1, "a": 2}', None, "duplicate_key"),
        ("{a: 1}", None, "not_json"),
        ('{"a": "' + "abcdefgh" * 6, None, "repetition"),
    ],
)
def test_strict_extraction(raw, json_text, code):
    assert extract(raw) == (json_text, code)


def test_strict_extraction_as_a_column(spark):
    df = spark.createDataFrame([('{"a":1}',), (None,), ("x",)], "raw string")
    assert [tuple(r.x) for r in df.select(extract_json(F.col("raw")).alias("x")).collect()] == [('{"a":1}', None), (None, "empty"), (None, "no_object")]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Città  È <10€ ß",), (None,)], "x string")
    rows = df.select(normalize_text(F.col("x")).alias("n"), text_key(F.col("x")).alias("k")).collect()
    assert tuple(rows[0]) == ("citta e 10", "città è <10€ ss") and tuple(rows[1]) == (None, None)
    t = spark.createDataFrame([("8:05", "25:10:09"), ("24:00", "0:0:1"), ("x", "1:2:3")], "a string, b string")
    got = t.select(clock_minutes(F.col("a")).alias("m"), service_seconds(F.col("b")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(485, 90609), (None, 1), (None, 3723)]
    d = spark.createDataFrame([(date(2026, 11, 26), 3), (date(2026, 11, 26), 2)], "d date, w int")  # a Thursday
    assert [r[0] for r in d.select(next_weekday(F.col("d"), F.col("w"))).collect()] == [date(2026, 11, 26), date(2026, 12, 2)]
    assert spark.range(1).select(clock_text(F.lit(485))).first()[0] == "08:05"


def test_similarity_equals_the_nested_loop(spark):
    import random

    r = random.Random(1)
    base = [[r.randrange(40) for _ in range(r.randint(0, 25))] for _ in range(25)]
    sets = [(i, sorted({str(x) for x in (b if r.random() < 0.5 else b[1:] + [99 + r.randrange(3)])})) for i, b in enumerate(base * 3)]
    df = spark.createDataFrame(sets, "id long, tokens array<string>")
    for percent in (50, 80, 85, 100):
        want = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}
        assert {(x.a, x.b) for x in similar_pairs(df, percent).collect()} == want
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    want = {(a, b) for a, x in sets for b, y in sets if a % 2 == 0 and b % 2 == 1 and x and y and 100 * len({*x} & {*y}) >= 80 * len({*x} | {*y})}
    assert {(x.a, x.b) for x in similar_across(left, right, 80).collect()} == want


def test_components(spark):
    import random

    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {x: find(x) for x in got} and {x for e in edges for x in e if None not in e and e[0] != e[1]} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long"), keep).count() == 0


def feed_zip(path):
    files = {
        "stops": "stop_id,stop_name,stop_lat\nA,Alba,1\nB,Borgo,1\nC1,Corte Nord,1\nC2,Corte Sud,1\n",
        "routes": "route_id,route_short_name,route_type\nR,RE1,2\nBUS,B1,3\n",
        "trips": "trip_id,route_id,service_id\nT1,R,S\nT2,R,S\nT3,BUS,S\nT4,R,S\nN,R,L\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "".join(f"{t},{a},{d},{s},{q}\n" for t, a, d, s, q in [("T1", "08:00:00", "08:00:00", "A", 1), ("T1", "08:30:00", "08:31:00", "B", 2), ("T1", "08:45:00", "08:45:00", "C1", 3), ("T2", "09:00:00", "09:00:00", "A", 1), ("T2", "09:20:00", "09:20:00", "C2", 2), ("T3", "08:10:00", "08:10:00", "A", 1), ("T3", "08:20:00", "08:20:00", "C1", 2), ("T4", "10:00:00", "10:00:00", "C1", 1), ("T4", "11:00:00", "11:00:00", "A", 2), ("N", "24:30:00", "24:30:00", "A", 1), ("N", "24:50:00", "24:50:00", "C1", 2)]),
        "calendar_dates": "service_id,date,exception_type\nS,20260302,1\nL,20260301,1\nL,20260303,2\n",
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(f"{name}.txt", "\ufeff" + text)
    return str(path)


def test_timetable(spark, tmp_path):
    path = feed_zip(tmp_path / "feed.zip")
    digest = hashlib.sha256((tmp_path / "feed.zip").read_bytes()).hexdigest()
    feed = read_zip(spark, path, digest)
    with pytest.raises(ValueError, match="hash"):
        read_zip(spark, path, "0" * 64)
    a, c = resolve_station(feed, "alba"), resolve_station(feed, "Corte", frozenset({"corte"}))
    assert c.count() == 2 and resolve_station(feed, "corte").count() == 0
    find = lambda **k: [(r.ref, r.trip_id, r.departs // 60, r.arrives // 60) for r in connections(feed, a, c, "2026-03-02", **k).collect()]
    assert find() == [("R0001", "N", 30, 50), ("R0002", "T1", 480, 525), ("R0003", "T2", 540, 560)]
    assert [x[1] for x in find(departure=Clock("after", 480, inclusive=False))] == ["T2"]
    assert [x[1] for x in find(arrival=Clock("before", 525))] == ["N", "T1"]
    assert [x[1] for x in find(arrival=Clock("before", 525, inclusive=False))] == ["N"]
    assert [x[1] for x in find(sort="duration", limit=2)] == ["N", "T2"]
    assert [x[1] for x in find(sort="arrival", descending=True, limit=1)] == ["T2"]
    assert find(departure=Clock("between", 481, 539)) == []


def test_dialogue_steps():
    d = Draft()
    assert step(d, 0, "update", None, {"a": "1"}) == "no_draft"
    assert step(d, 1, "open", "find", {"from": "A"}) == "" and d.revision == 1
    assert missing_slots(d, ["from", "to"]) == ["to"]
    assert step(d, 2, "confirm", None, None) == "" and d.confirmed
    assert step(d, 3, "update", None, {"from": "A"}) == "unchanged" and d.confirmed
    assert step(d, 4, "update", None, {"to": "B"}) == "" and not d.confirmed and d.revision == 2
    assert step(d, 4, "cancel", None, None) == "late_turn"
    assert step(d, 5, "confirm", None, None) == "" and Draft.load(d.dump()) == d
    assert step(d, 6, "cancel", None, None) == "" and d.status == "cancelled" and step(d, 7, "update", None, {"x": "1"}) == "no_draft"
    assert step(d, 8, "jump", None, None) == "unknown_operation"
    with pytest.raises(ValueError, match="version"):
        Draft.load(json.dumps({"version": 0}))


def test_dialogue_replay_equals_the_stream(spark, tmp_path):
    rows = [(c, i, op, "find", json.dumps(s)) for c in ("x", "y") for i, (op, s) in enumerate([("open", {"a": c}), ("update", {"b": "2"}), ("confirm", {}), ("update", {"a": None}), ("cancel", {})])]
    ddl = "conversation string, turn long, operation string, action string, slots string"
    batch = {tuple(r) for r in replay(spark.createDataFrame(rows, ddl)).collect()}
    assert len(batch) == 10 and ("x", 3, "open", 3, '{"b": "2"}', False, "") in batch
    for k in range(2):
        spark.createDataFrame(rows[k * 3 :: 1][: 3 if k == 0 else None], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = follow(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("dialogue").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("dialogue").collect()}
    assert batch == {r for r in got if r[6] != "late_turn"}


def test_text_keys_are_made_a_run_at_a_time(spark):
    import unicodedata

    import pyarrow as pa

    from quillspark.functions.text import _fold

    texts = [None, "", " A\tb  C\x1c", "Straße ﬁn", "Ａ１ é <10", "ǅ İ"] * 40
    want = [None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) for x in texts]
    assert [b.to_pylist() for b in _fold(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]))] == [want, []]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").coalesce(1)
    assert [r.k for r in df.select("i", text_key(F.col("x")).alias("k")).orderBy("i").collect()] == want
