"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources share all words by weight; no target is over `most` times its source's size, and the
excess is shared again by weight until none is above.

Each source has a schedule, piecewise linear in training time 0..1. Its integral, scaled to the source's
target, is the source's cumulative demand; a source's documents, in a hashed order and repeated as often
as the target needs, cover that demand end to end, and inverting the demand at a document's start gives
its training position. Documents are range-sorted by position. The document at a target's end is taken
in part, so each source's taken words equal its target rounded.

Cumulative sizes come from cells of about `cell_rows` documents, so a source is never one task. The
driver holds one row for each source, to share the words out; a schedule travels with its source's rows.

A null text has size 0, a null source is a source of its own, last in order. Documents of size 0 take
nothing and have no position. Rows are separate documents, also where ids are null or repeat (rows with
one id and text are in one cell). Reruns over the same files agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from quillspark.llm import shared
from quillspark.llm.packing import WORD


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none over most * size.

    >>> targets([100, 10, 100], [1, 2, 3])
    [45.0, 30.0, 135.0]
    """
    out, capped, left = [0.0] * len(sizes), [s == 0 for s in sizes], float(sum(sizes))
    while True:
        free = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        if not free:
            return out
        over = [i for i, c in enumerate(capped) if not c and left * weights[i] / free > most * sizes[i]]
        if not over:
            return [left * w / free if not c else t for w, c, t in zip(weights, capped, out, strict=True)]
        for i in over:
            out[i], capped[i] = float(most * sizes[i]), True
        left = sum(sizes) - sum(t for t, c in zip(out, capped, strict=True) if c)


def ramps(rank: int) -> list[tuple[float, float]]:
    """The default schedules: every third source level, rising or falling."""
    return [[(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.5), (1.0, 0.5)]][rank % 3]


def invert(knots: list[tuple[float, float]], demand: np.ndarray) -> np.ndarray:
    """Times at which the integral of a piecewise linear schedule, as a share of the whole, reaches demand."""
    t, w = (np.array(x, float) for x in zip(*knots, strict=True))
    part = np.diff(t) * (w[1:] + w[:-1]) / 2
    done = np.concatenate([[0], np.cumsum(part)])
    y = np.clip(demand, 0, 1) * done[-1]
    k = np.clip(np.searchsorted(done, y, "right") - 1, 0, len(part) - 1)
    slope = (w[k + 1] - w[k]) / (t[k + 1] - t[k])
    rest = y - done[k]
    # rest = w x + slope x^2 / 2, in a form that stays good where slope is 0
    root = np.sqrt(np.maximum(w[k] ** 2 + 2 * slope * rest, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(rest > 0, 2 * rest / (w[k] + root), 0)
    return np.minimum(t[k] + x, t[-1])


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, cell_rows: int = 2_000, schedule: Callable[[int], list[tuple[float, float]]] = ramps, carry: list[str] | None = None) -> DataFrame:
    """Per document: id, carried columns, size, source_size, target, taken and positions (one for each pass begun)."""
    spark = docs.sparkSession
    carry = carry or []
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("z"))
    spot = F.when(F.col(id_col).isNull(), F.col("__spot"))
    table = shared.numbered(docs, "__spot", "mix-texts").select("__spot", F.col(id_col).alias("__id"), key.alias("__key"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), spot).alias("__h"), *carry)
    table = shared.keep(table, "mix-rows")
    # "s" sorts before "z", and Python compares by code point
    found = sorted((r["__key"], r.n, r.s) for r in table.groupBy("__key").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect())
    goal = targets([s for _, _, s in found], [1 + i % 3 for i in range(len(found))], most)
    plan = [(k, i, -(-n // cell_rows), s, g, int(g + 0.5), *zip(*schedule(i), strict=True)) for i, ((k, n, s), g) in enumerate(zip(found, goal, strict=True))]
    facts = spark.createDataFrame(plan, "__key string, __rank int, __cells int, source_size long, target double, __goal long, __t array<double>, __w array<double>")
    facts = F.broadcast(facts) if len(plan) <= 100_000 else facts
    unit = F.shiftrightunsigned("__h", 11) / float(1 << 53)
    cells = table.join(facts, "__key").withColumn("__cell", F.floor(unit * F.col("__cells")).cast("int"))
    sums = cells.groupBy("__key", "__cell").agg(F.sum("size").alias("__sum"))
    before = sums.select("__key", "__cell", (F.sum("__sum").over(Window.partitionBy("__key").orderBy("__cell")) - F.col("__sum")).alias("__before"))
    inside = F.sum("size").over(Window.partitionBy("__key", "__cell").orderBy("__h", "__spot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = cells.withColumn("__inside", inside).join(before, ["__key", "__cell"]).withColumn("__start", F.col("__before") + F.col("__inside"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            size, start, whole, goal, rank = (x.column(c).to_numpy() for c in ("size", "__start", "source_size", "__goal", "__rank"))
            at = start[:, None] + whole[:, None] * np.arange(most)
            taken = np.clip(goal[:, None] - at, 0, size[:, None])
            position = np.zeros(at.shape)
            for r, example in zip(*np.unique(rank, return_index=True), strict=True):
                mine = rank == r
                knots = list(zip(x.column("__t")[example].as_py(), x.column("__w")[example].as_py(), strict=True))
                position[mine] = invert(knots, at[mine] / np.maximum(goal[mine], 1)[:, None])
            begun = (taken > 0).sum(axis=1)
            passes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(begun)]), pa.int32()), pa.array(position[taken > 0]))
            yield pa.RecordBatch.from_arrays([x.column("__id"), *(x.column(c) for c in carry), x.column("size"), x.column("source_size"), x.column("target"), pa.array(taken.sum(axis=1)), passes], [id_col, *carry, "size", "source_size", "target", "taken", "positions"])

    schema = T.StructType([docs.schema[id_col], *(docs.schema[c] for c in carry), T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("taken", T.LongType()), T.StructField("positions", T.ArrayType(T.DoubleType()))])
    return placed.select("__id", *carry, "size", "source_size", "target", "__start", "__goal", "__rank", "__t", "__w").mapInArrow(assign, schema)


def ordered(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The curriculum: a row for each pass, range-sorted by training position."""
    passes = mixed.select("*", F.posexplode("positions").alias("pass", "position")).drop("positions")
    return passes.repartitionByRange("position", id_col, "pass").sortWithinPartitions("position", id_col, "pass")
