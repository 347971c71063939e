"""Interval joins against all pairs."""

import random

from quillspark.operators.intervals import interval_join


def test_points_meet_the_intervals_that_hold_them(spark):
    r = random.Random(1)
    spans = [(i, r.choice("ab"), r.randrange(-50, 400), r.randrange(-50, 400)) for i in range(300)] + [(900, "a", None, 5), (901, "b", 7, 7), (902, "c", 0, 9)]
    points = [(i, r.choice("ab"), r.randrange(-60, 420)) for i in range(300)] + [(900, "a", None), (901, "b", 7), (902, None, 3)] + [(2000 + i, "a", 100) for i in range(50)]
    s, p = spark.createDataFrame(spans, "s int, k string, low int, high int"), spark.createDataFrame(points, "p int, k string, at int")
    want = sorted((a, b) for a, k, low, high in spans for b, q, at in points if k == q and None not in (low, at) and low <= at <= high)
    for width in (1, 7, 60, 1000):
        assert sorted((x.s, x.p) for x in interval_join(s, p, ["k"], "low", "high", "at", width).collect()) == want


def test_an_interval_meets_only_points_near_it(spark):
    """Work follows the points in the buckets that an interval touches, not all points of its key."""
    s = spark.createDataFrame([(0, "a", 100, 110)], "s int, k string, low int, high int")
    p = spark.range(100_000).selectExpr("'a' AS k", "cast(id AS int) AS at")
    out = interval_join(s, p, ["k"], "low", "high", "at", 50)
    assert out.count() == 11
    met = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in met
