"""A resumable sink: each micro-batch has a folder of its own, so a batch that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def resumable(stream: DataFrame, path: str, checkpoint: str, *, key: list[str] | None = None, after: Callable[[int], None] | None = None) -> DataStreamWriter:
    """A writer of the stream to `path`, not started.

    The engine runs a batch again where it ended before its commit; its folder is then written anew, so no row
    is lost or doubled. With a key, rows whose key an earlier batch has written are left out (a source that
    sends rows again after its own restart), and of a batch's equal keys one stays. `after` is called when a
    batch is written, before its commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        if key:
            batch = batch.dropDuplicates(key)
            done = written(batch.sparkSession, path, batch.schema.json(), before=number)
            if done is not None:
                batch = batch.join(done.select(*key), key, "left_anti")
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def written(spark: SparkSession, path: str, schema: str | None = None, before: int | None = None) -> DataFrame | None:
    """All rows of the sink, or those of batches before one; None where there are none yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    names = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where) if s.getPath().getName().startswith("batch="))
    names = [n for n in names if before is None or n < before]
    # a folder without its mark was being written when the query ended
    names = [n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/batch={n}/_SUCCESS"))]
    return spark.read.parquet(*(f"{path}/batch={n}" for n in names)) if names else None
