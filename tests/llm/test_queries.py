"""Every registered query over the smallest tables; those with SQL must equal it."""

from pathlib import Path

import duckdb
import pytest

from quillspark.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns, data = [c[0] for c in want.description], want.fetchall()
    got = QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, data))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_cross_polytope"}))
def test_query_runs(spark, name):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert QUERIES[name](spark, str(DATA)).count() == documents


def test_search_answers_each_query_in_full(spark):
    rows = QUERIES["op11_cross_polytope"](spark, str(DATA)).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    asked = [i for i in vectors if i % 20 == 0]
    per = {i: sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == i) for i in asked}
    assert len(rows) == 20 * len(asked)
    hits = 0
    for i, found in per.items():
        exact = {j: sum(a * b for a, b in zip(vectors[i], v, strict=True)) for j, v in vectors.items() if j != i}
        best = sorted(exact, key=lambda j: (-exact[j], j))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(exact[j] - s) < 1e-12 for _, j, s in found)
        assert [j for _, j, _ in found] == sorted((j for _, j, _ in found), key=lambda j: (-exact[j], j))
        hits += len(set(best) & {j for _, j, _ in found})
    assert hits >= 0.9 * len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, str(DATA))
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        if name != "mixing":
            assert after.count() <= before.count() and after.join(before, docs.columns, "left_anti").count() == 0
            assert after.select("doc_id").distinct().count() == after.count()
        before = after
    last = pipeline.STAGES[-1][1](spark, before, str(DATA))
    assert last.count() == before.count() > 0
    empty = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(DATA)).count() == 0, name
    odd = spark.createDataFrame([(None, "a b c", None, None, None), (None, None, "en", "s", 0), (7, "x y", "en", "s", 3), (7, "x y", "en", "s", 3), (8, "", None, "s", 0)], docs.schema)
    for name, stage in pipeline.STAGES:
        rows = stage(spark, odd, str(DATA)).collect()
        assert len(rows) <= 15, name
