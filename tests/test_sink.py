"""A stream that ends between a batch's write and its commit, and goes on."""

import pytest
from pyspark.sql import functions as F

from quillspark.streaming.sink import resumable, written


def feed(spark, path, ids):
    spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = resumable(stream, str(tmp_path / "out"), str(tmp_path / "ck"), **options).trigger(availableNow=True).start()
    q.awaitTermination()


def test_no_row_is_lost_or_doubled_where_the_query_ends_before_a_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        feed(spark, str(tmp_path / "in"), range(k * 10, k * 10 + 10))
    marks = []

    def end(number):
        marks.append(number)
        if number == 1 and marks.count(1) == 1:
            raise RuntimeError("the driver ends here")

    with pytest.raises(Exception, match="driver ends here"):
        run(spark, tmp_path, after=end)
    assert written(spark, str(tmp_path / "out")).count() == 20
    run(spark, tmp_path, after=end)
    got = [r.id for r in written(spark, str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(40)) and marks == [0, 1, 1, 2, 3]


def test_rows_sent_again_are_left_out_by_key(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [1, 2, 3, 3])
    run(spark, tmp_path, key=["id"])
    feed(spark, str(tmp_path / "in"), [3, 4, 1])
    run(spark, tmp_path, key=["id"])
    assert sorted(r.id for r in written(spark, str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_a_folder_without_its_mark_is_not_read(spark, tmp_path):
    assert written(spark, str(tmp_path / "none")) is None
    feed(spark, str(tmp_path / "in"), [1])
    run(spark, tmp_path)
    half = tmp_path / "out" / "batch=7"
    spark.range(3).select(F.col("id"), F.lit("half").alias("v")).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert [r.id for r in written(spark, str(tmp_path / "out")).collect()] == [1]
