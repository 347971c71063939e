"""A fold over the rows of each key in order: what depends on all rows before can't be a window's frame.

Rows are dealt by key and sorted within partitions; a task reads them batch by batch and holds the state of
one key, never a key's rows. A key of any length is one task's time, not its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def fold(rows: DataFrame, key: str, order: list[str | Column], start: Callable[[], Any], step: Callable[[Any, dict], tuple], result: str | T.StructType, *, held: int = 4096) -> DataFrame:
    """One result row for each row: step(state, row) changes the key's state and returns the row's result.

    `order` should tell all rows of a key apart; equal places are taken in any order. A null key is a key.
    """
    schema = T._parse_datatype_string(result) if isinstance(result, str) else result
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, ()
        for batch in batches:
            for at in range(0, batch.num_rows, held):
                out = []
                for row in batch.slice(at, held).to_pylist():
                    if now != (row[key],):
                        now, state = (row[key],), start()
                    out.append(step(state, row))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
