import pytest
from pyspark.sql import functions as F

from quillspark.functions import grounding as G

TEXT = "Vorrei 2 panini rossi alle 20:30, massimo 12,50 € a Città Nuova, per tre persone"


@pytest.mark.parametrize(
    ("value", "said"),
    [(None, True), ("", True), ("2", True), ("12.5", True), ("12,50", True), ("3", True), ("4", False), ("20:30", True), ("20", True), ("21:00", False), ("panino", True), ("rosso", True), ("Città nuova", True), ("pizza", False), ("panini|rossi", True), ("panini|verdi", False), ("a", True)],
)
def test_values(spark, value, said):
    df = spark.createDataFrame([(value, TEXT)], "v string, t string")
    assert df.select(G.value_is_grounded(F.col("v"), F.col("t"))).first()[0] is said


def test_currency_action_and_markers(spark):
    rows = [("EUR", TEXT, True), (None, TEXT, True), ("usd", TEXT, False), ("JPY", TEXT, False), ("usd", "100 dollari", True)]
    df = spark.createDataFrame(rows, "c string, t string, w boolean")
    assert all(r[0] == r.w for r in df.select(G.currency_is_grounded(F.col("c"), F.col("t")).alias("g"), "w").collect())
    rows = [("vorrei", True), ("trovami", False), ("vorremmo", True), ("per tre", True), ("", False), (None, False), ("tre panini", True), ("tre pizze", False)]
    df = spark.createDataFrame([(a, TEXT, w) for a, w in rows], "a string, t string, w boolean")
    assert [(r[0]) for r in df.select(G.action_is_grounded(F.col("a"), F.col("t")).alias("g"), "w").collect()] == [w for _, w in rows]
    one = spark.createDataFrame([(TEXT,)], "t string")
    assert one.select(G.has_any(F.col("t"), ["vorrèi"]), G.has_any(F.col("t"), ["preferibilmente"])).first()[:] == (True, False)


def test_spans_buckets_and_thresholds(spark):
    df = spark.createDataFrame([("PANINI", TEXT), ("pani", TEXT), ("12,50 €", TEXT), ("", TEXT), (None, TEXT), ("a.b", "x axb a.b")], "v string, t string")
    got = [None if r[0] is None else tuple(r[0]) for r in df.select(G.literal_span(F.col("v"), F.col("t"))).collect()]
    at = TEXT.index("panini"), TEXT.index("12,50 €")
    assert got == [(at[0], at[0] + 6), None, (at[1], at[1] + 7), None, None, (6, 9)]
    df = spark.createDataFrame([("color", "neq"), ("price", "eq"), ("rating", "gte"), ("color", "eq")], "p string, o string")
    assert [r[0] for r in df.select(G.bucket(F.col("p"), F.col("o"))).collect()] == ["constraints"] * 3 + ["attributes"]
    from quillspark.operators import requests as Q

    df = spark.createDataFrame([("massimo 12 euro", "12"), ("almeno 3 stelle", "3"), ("meno di 5", "5"), ("oltre 10 e sotto 20", "10"), ("oltre 10 e sotto 20", "20"), ("nessuno", "1")], "t string, v string")
    assert [r[0] for r in df.select(Q.strictness(F.col("t"), F.col("v"))).collect()] == ["lte", "gte", "lt", "gt", None, None]


def test_aliases_and_padded_numbers(spark):
    rows = [("female", "una gatta femmina", True), ("direct", "un volo senza scali", True), ("used", "una bici", False), ("4700", "compra 47 cose", False), (" 47 | 3", "47 o 3", True)]
    df = spark.createDataFrame(rows, "v string, t string, w boolean")
    assert [r[0] for r in df.select(G.value_is_grounded(F.col("v"), F.col("t"))).collect()] == [w for *_, w in rows]
