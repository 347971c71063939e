from pyspark.sql import functions as F

from quillspark.operators.scoring import rates
from quillspark.operators.tables import counted, for_kinds, once_each


def requests(spark, n, kinds):
    kind = F.when(F.col("id") % kinds > 0, (F.col("id") % kinds).cast("string"))
    return spark.range(n).select(F.col("id").cast("string").alias("case"), kind.alias("raw"))


def test_rows_of_one_value_are_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def f(x):
        count = F.udf(lambda raw: asked.add(1) or f"{raw}!", "string")
        return x.withColumn("said", count("raw"))

    for few in (20_000, 0):
        before = asked.value
        got = {r.case: r.said for r in once_each(requests(spark, 3000, 10), ["raw"], f, few).collect()}
        assert asked.value - before == 10
        assert got == {str(i): f"{i % 10 or None}!" for i in range(3000)}


def test_rows_of_a_case_stand_for_its_kind(spark):
    f = lambda x: x.where("raw IS NULL OR raw <> '3'").select("case", F.explode(F.array("raw", F.lit("x"))).alias("out"))
    for n, kinds in ((3000, 10), (20, 40)):
        x = requests(spark, n, kinds)
        want = sorted(map(tuple, f(x).collect()), key=repr)
        for few in (20_000, 0):
            assert sorted(map(tuple, for_kinds(x, ["raw"], f, few).collect()), key=repr) == want


def test_totals_ask_each_value_once_and_join_nothing_back(spark):
    asked = spark.sparkContext.accumulator(0)

    def f(x):
        one = F.udf(lambda raw: asked.add(1) or int(raw or 0), "long")
        return x.withColumn("hit", one("raw"))

    for n, kinds in ((3000, 10), (20, 40)):
        x, before = requests(spark, n, kinds), asked.value
        (got,) = rates(counted(x, ["raw"], f), [], {"rate": ("hit", ["hit"])}, weight="weight").select("n", "hit").collect()
        assert asked.value - before == min(n, kinds)
        assert tuple(got) == (n, sum(i % kinds for i in range(n)))
    none = rates(counted(requests(spark, 0, 10), ["raw"], f), [], {"rate": ("hit", ["hit"])}, weight="weight")
    assert none.first().n == 0


def test_rates_of_contracts_score_each_pair_once(spark, tmp_path, monkeypatch):
    from quillspark.operators import requests as Q
    from quillspark.plans.catalog import QUERIES

    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_suppkey long"
    spark.createDataFrame([(o, ln, float(ln), 0.0, 0.0, 1) for o in range(50) for ln in range(1, 3 + o % 2)], columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    asked = []
    monkeypatch.setattr(Q, "score_12", lambda x: asked.append(x.count()) or x.select("weight", F.lit(True).alias("schema_valid"), *(F.lit(1).alias(c) for c in Q.C.COUNTERS_12)))
    assert QUERIES["contract_rates_12"](spark, str(tmp_path)).first().n == 50
    assert asked == [2]


def test_rows_meet_their_kind_by_digest_also_of_nested_values(spark):
    kind = F.col("id") % 5
    x = spark.range(2000).select(F.col("id").cast("string").alias("case"), F.array(F.struct(F.when(kind > 0, kind).alias("a"), F.when(kind == 0, kind).alias("b"))).alias("set"))
    f = lambda x: x.withColumn("said", F.to_json("set"))
    want = {r.case: r.said for r in f(x).collect()}
    for few in (20_000, 0):
        told = once_each(x, ["set"], f, few)
        assert {r.case: r.said for r in told.collect()} == want
        joins = [line for line in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joins and all("__id" in line and "set" not in line for line in joins)


def test_contracts_and_pairs_of_equal_orders_are_written_once(spark, tmp_path, monkeypatch):
    from quillspark.plans import contracts, requests as plans
    from quillspark.plans.catalog import QUERIES

    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame([(o, ln, 1, 1, float(ln), 10.0, 0.0, 0.0) for o in range(50) for ln in range(1, 3 + o % 2)], columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "PROMO")], "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    made = []
    for module, name in ((contracts, "written"), (plans, "pairs_of")):
        old = getattr(module, name)
        monkeypatch.setattr(module, name, lambda x, *more, old=old: made.append(x.count()) or old(x, *more))
    assert QUERIES["contract_verdicts"](spark, str(tmp_path)).count() == 50
    assert QUERIES["contract_equalities"](spark, str(tmp_path)).count() == 50
    assert made == [2, 2]
