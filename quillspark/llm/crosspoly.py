"""Nearest neighbours by inner product through cross-polytope hashing.

A vector is turned by seeded pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and
hashed to the signed axis that it is nearest to. Inner products are turned into angles first: vectors are
grouped by norm (factors of two), each is scaled by its group's largest norm M and gets the coordinate that
makes it a unit vector; queries are scaled to length one with 0 there. Several hashes make a table's cell, the
last over fewer axes, so that a cell holds about `occupancy` vectors at every size of the table.

1. Rows of one vector are a class, of which the k + 1 first rows by id are held; no query can need more.
2. `sample` queries are answered exactly against all rows. A query probes a table's cells in the order of the
   sums of its turned coordinates; the share of cells that finds `recall` of the sample's neighbours is taken
   for all queries, at least one cell a table. So the recall is measured on the data, at every size.
3. Vectors go to their cell in each table, queries to the cells that they probe. Cells of more than `chunk`
   vectors are split, and queries visit each piece; queries are streamed past a piece, so neither a hot cell
   nor its queries are held at once. Candidates' scores are summed again in order of the coordinates.
4. Queries that found fewer than there are probe all cells of one table.

Scores are double precision sums of products, from the first coordinate to the last; ties go to the smaller id,
then to the row's place. Vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of different lengths are no candidates of each other. Each row is a vector of its own, also where its
id is null (never a query, last among ties) or repeats (each row is a query and a candidate; the result has its
rows once for each). With fewer than k candidates all are returned; an empty table gives none. Classes go by
128-bit hashes. The share of cells grows where neighbours are hardly nearer than the rest (random directions
in 64 dimensions: about a quarter of 50,000), and with it the work; a hot cell of m vectors costs m / 20 times
m products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared

CODE_BITS = 40  # of a cell's key; above them are table and norm group


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix over sqrt(d); d is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def turned(unit: np.ndarray, table: int, level: int, seed: int = 11) -> np.ndarray:
    """The rows after a pseudo-rotation of their own for each table and level."""
    signs = np.random.default_rng([seed, table, level, unit.shape[1]]).choice([-1.0, 1.0], (3, unit.shape[1]))
    for s in signs:
        unit = hadamard(unit * s)
    return unit


def axes_for(n: int, occupancy: int, width: int) -> list[int]:
    """Axes of each hash of a cell, powers of two up to width: about n / occupancy cells."""
    bits, out = min(CODE_BITS, max(0, math.floor(math.log2(max(n, 1) / occupancy)))), []
    full = 1 + int(math.log2(width))
    while bits > 0:
        out.append(1 << (min(bits, full) - 1))
        bits -= full
    return out


def signed(x: np.ndarray, axes: int) -> np.ndarray:
    """The score of each signed axis: coordinates, then their negatives."""
    return np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)


def codes(unit: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    out = np.zeros(len(unit), np.int64)
    for level, m in enumerate(axes):
        out = out * (2 * m) + np.argmax(signed(turned(unit, table, level), m), axis=1)
    return out


def probe_order(unit: np.ndarray, table: int, axes: list[int], want: int) -> np.ndarray:
    """(rows, want) cells in falling order of the sum of their axes' scores."""
    cell, score = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for level, m in enumerate(axes):
        s = signed(turned(unit, table, level), m)
        # the best `want` of a prefix hold the prefixes of the best `want` of all
        total = (score[:, :, None] + s[:, None, :]).reshape(len(unit), -1)
        both = (cell[:, :, None] * (2 * m) + np.arange(2 * m)).reshape(len(unit), -1)
        few = min(want, total.shape[1])
        best = np.argpartition(-total, few - 1, axis=1)[:, :few] if few < total.shape[1] else np.broadcast_to(np.arange(few), total.shape)
        cell, score = np.take_along_axis(both, best, 1), np.take_along_axis(total, best, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(cell, order, 1)


def scaled(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, rows, vectors, vectors of length one, log2 of their norms) of a list column without unusable rows."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    at, out = np.concatenate([[0], np.cumsum(n)]), []
    for d in np.unique(n).tolist():
        rows = np.flatnonzero(n == d)
        v = values[K.ranges(at[rows], np.full(len(rows), d))].reshape(-1, d)
        top = np.abs(v).max(axis=1)
        y = v / top[:, None]
        size = np.sqrt((y * y).sum(axis=1))
        out.append((d, rows, v, y / size[:, None], np.log2(top) + np.log2(size)))
    return out


def norm_group(log_norm: np.ndarray) -> np.ndarray:
    return np.floor(log_norm + 0.5).astype(np.int64)


def lifted(unit: np.ndarray, log_norm: np.ndarray, log_top: float) -> np.ndarray:
    """Unit vectors of a power of two's length whose angles to unit queries follow the inner products."""
    n, d = unit.shape
    width = 1 << d.bit_length()
    share = np.minimum(np.exp2(log_norm - log_top), 1.0)
    out = np.zeros((n, width))
    out[:, :d] = unit * share[:, None]
    out[:, d] = np.sqrt(np.maximum(0.0, 1.0 - share * share))
    return out


def raised(unit: np.ndarray) -> np.ndarray:
    out = np.zeros((len(unit), 1 << unit.shape[1].bit_length()))
    out[:, : unit.shape[1]] = unit
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed from the first coordinate to the last."""
    total = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        total += x * y
    return total


def best_of(query: np.ndarray, cand: np.ndarray, score: np.ndarray, none: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best distinct candidates."""
    order = np.lexsort((cand, first, none, -score, query))
    q, c = query[order], cand[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    order, q = order[fresh], q[fresh]
    starts = K.segments(q)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
    return order[place < k]


def strongest(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) places that hold each query's k best, and what ties with the last of them up to rounding."""
    block = queries @ vectors.T
    if block.shape[1] > k:
        least = -np.partition(-block, k - 1, axis=1)[:, k - 1]
        size = np.abs(queries).max(axis=1) * np.abs(vectors).max() * queries.shape[1]
        return np.nonzero(block >= (least - 1e-12 * size)[:, None])
    return np.nonzero(np.ones(block.shape, bool))


def nearest(table: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 4, occupancy: int = 256, sample: int = 64, recall: float = 0.96, chunk: int = 4096, few: int = 1_000_000) -> DataFrame:
    """The k nearest of each row for which `queries` holds: query_id, rank from 1, the id and score."""
    spark = table.sparkSession
    v = F.col(vector_col)
    if table.schema[vector_col].dataType.elementType not in (T.FloatType(), T.DoubleType()):
        v = v.cast("array<double>")
    fit = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = table.where(fit).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    base = shared.numbered(rows, "row", "ann-rows")
    same = ["h1", "h2"]
    by_id = [F.col("id").isNull(), "id", "row"]
    first = base.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(*by_id))).where(F.col("place") <= k + 1)
    entry = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = first.groupBy(*same).agg(F.first("v").alias("v"), F.sort_array(F.collect_list(entry)).alias("members"))  # at most k + 1
    asked = base.where("asked").groupBy(*same).agg(F.lit(True).alias("asked"))
    classes = classes.join(asked, same, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    classes = shared.keep(classes.withColumn("c", F.monotonically_increasing_id()), "ann-classes")
    index = _Index(classes, tables, occupancy)
    coded = index.coded()
    share = index.share(coded, k, sample, recall)
    sizes = shared.keep(coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("held")), "ann-sizes")
    small = sizes.count() <= few
    pieces = F.ceil(F.col("held") / chunk).cast("int")

    def placed(df: DataFrame, deal: str) -> DataFrame:
        if small:
            return df.join(F.broadcast(sizes), "cell")
        return shared.spread_join(df, sizes, ["cell"], shared.hot_of(sizes, ["cell"], "held", coded.count() * tables), [deal])

    lead = F.col("members")[0]
    heads = classes.select("c", lead["none"].alias("none"), lead["id"].cast("long").alias("first"))
    there = placed(coded.select("c", "v", F.explode("cells").alias("cell")), "c").select("cell", F.pmod(F.xxhash64("c"), pieces).cast("int").alias("piece"), F.lit(0).alias("kind"), "c", "v")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shared.buckets(coded, 4 << 20, 1) * tables)

    def answers(asking: DataFrame, share: float, of: int) -> DataFrame:
        """(c, found) of the asking classes: their k + 1 best rows as (loss, none, id, row)."""
        probes = placed(index.probes(asking, share, of), "c")
        probes = probes.select("cell", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.lit(1).alias("kind"), "c", "v")
        units = there.unionByName(probes).repartition(parts, "cell", "piece").sortWithinPartitions("cell", "piece", "kind", "c")
        hits = shared.keep(units.mapInArrow(lambda b: _judged(b, k + 1), _HITS), "ann-hits").distinct().join(heads.withColumnRenamed("c", "candidate"), "candidate")
        order = Window.partitionBy("c").orderBy(F.col("score").desc(), "none", "first", "candidate")
        hits = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        each = hits.select("c", "candidate", "score").join(classes.select(F.col("c").alias("candidate"), F.explode("members").alias("m")), "candidate")
        best = Window.partitionBy("c").orderBy(F.col("score").desc(), "m")
        each = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
        return each.groupBy("c").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("loss"), "m.none", "m.id", "m.row"))).alias("found"))

    asking = coded.where("asked")
    found = shared.keep(answers(asking, share, tables), "ann-found")
    rows_of = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows"))
    least = asking.select("c", F.size("v").alias("d")).join(F.broadcast(rows_of) if len(index.shapes) <= few else rows_of, "d").select("c", F.least(F.col("rows"), F.lit(k + 1)).alias("least"))
    short = least.join(found, "c", "left").where(F.coalesce(F.size("found"), F.lit(0)) < F.col("least")).select("c")
    short = shared.keep(short, "ann-short")
    if short.limit(1).count():
        found = found.join(short, "c", "left_anti").unionByName(answers(asking.join(short, "c", "left_semi"), 1.0, 1))
    who = base.where("asked").select("id", "row", *same).join(classes.where("asked").select(*same, "c"), same)
    who = shared.keep(who.select("id", "row", "c"), "ann-askers")
    out = shared.spread_join(who, found, ["c"], shared.hot_keys(who, "c"), ["row"])
    others = F.slice(F.filter("found", lambda x: x["row"] != F.col("row")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.loss")).alias("score"))


_HITS = T.StructType([T.StructField("c", T.LongType()), T.StructField("candidate", T.LongType()), T.StructField("score", T.DoubleType())])


class _Index:
    """Norm groups of each length, and how many axes hash each."""

    def __init__(self, classes: DataFrame, tables: int, occupancy: int):
        self.classes, self.tables = classes, tables

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows, _, _, size in scaled(batch.column("v")):
                    group = norm_group(size)
                    for g in np.unique(group).tolist():
                        mine = size[group == g]
                        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([g]), pa.array([len(mine)]), pa.array([mine.max()])], ["d", "g", "n", "top"])

        found = classes.select("v").mapInArrow(measure, "d long, g long, n long, top double").groupBy("d", "g").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
        # a row for each length and power of two of the norms: at most 2,100 a length
        self.shapes = {(r.d, r.g): (i, axes_for(r.n, occupancy, 1 << r.d.bit_length()), r.top) for i, r in enumerate(found.orderBy("d", "g").collect())}

    def cell_keys(self, number: int, table: int, code: np.ndarray) -> np.ndarray:
        return code | np.int64(number * self.tables + table) << np.int64(CODE_BITS)

    def cells_of(self, d: int, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(rows, tables) cells of vectors of one length."""
        out, group = np.zeros((len(unit), self.tables), np.int64), norm_group(size)
        for g in np.unique(group).tolist():
            mine = np.flatnonzero(group == g)
            number, axes, top = self.shapes[d, g]
            for at in range(0, len(mine), 4096):
                part = mine[at : at + 4096]
                full = lifted(unit[part], size[part], top)
                for t in range(self.tables):
                    out[part, t] = self.cell_keys(number, t, codes(full, t, axes))
        return out

    def coded(self) -> DataFrame:
        """(c, v, asked, cells) of all classes, written."""

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows, _, unit, size in scaled(batch.column("v")):
                    cells = self.cells_of(d, unit, size)
                    to = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * self.tables)
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("c", "v", "asked")), pa.ListArray.from_arrays(to, pa.array(cells.ravel()))], ["c", "v", "asked", "cells"])

        source = self.classes.select("c", "v", "asked")
        return shared.keep(source.mapInArrow(code, T.StructType([*source.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])), "ann-coded")

    def wanted(self, axes: list[int], share: float) -> int:
        return max(1, math.ceil(share * math.prod(2 * m for m in axes)))

    def share(self, coded: DataFrame, k: int, sample: int, recall: float) -> float:
        """The share of a table's cells that finds `recall` of the sampled queries' true neighbours."""
        taken = coded.where("asked").orderBy(F.xxhash64("v")).limit(sample).select("c", "v").toArrow()
        if not taken.num_rows:
            return 1.0
        vectors = [(d, rows, v, unit) for d, rows, v, unit, _ in scaled(taken["v"].combine_chunks())]
        own = taken["c"].to_numpy()

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The sample's best of this task."""
            held = None
            for batch in batches:
                parts = [] if held is None else [held]
                c, cells = batch.column("c").to_numpy(), batch.column("cells").flatten().to_numpy().reshape(-1, self.tables)
                for d, rows, v, _, _ in scaled(batch.column("v")):
                    for d2, at, q, _ in vectors:
                        if d2 == d:
                            i, j = strongest(q, v, k + 1)
                            parts.append((at[i], c[rows[j]], products(q[i], v[j]), cells[rows[j]]))
                if parts:
                    q, c, score, cells = (np.concatenate(x) for x in zip(*parts, strict=True))
                    mine = own[q] != c
                    q, c, score, cells = q[mine], c[mine], score[mine], cells[mine]
                    zero = np.zeros(len(q), np.int64)
                    best = best_of(q, c, score, zero, zero, k)
                    held = tuple(x[best] for x in (q, c, score, cells))
            if held is not None and len(held[0]):
                q, c, score, cells = held
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score), pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * self.tables), pa.array(cells.ravel()))], ["q", "score", "cells"])

        best = coded.select("c", "v", "cells").mapInArrow(exact, "q long, score double, cells array<long>")
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "cells"))).where(F.col("place") <= k)
        true = best.select("q", "cells").toArrow()  # sample * k rows at most
        if not true.num_rows:
            return 1.0
        needs, shapes = [], {i: (axes, d) for (d, _), (i, axes, _) in self.shapes.items()}
        of, cells = true["q"].to_numpy(), np.array(true["cells"].to_pylist(), np.int64).reshape(-1, self.tables)
        for d, at, _, unit in vectors:
            full = raised(unit)
            for place, q in enumerate(at.tolist()):
                mine = cells[of == q]
                if not len(mine):
                    continue
                least = np.full(len(mine), 1.0)
                for t in range(self.tables):
                    for number in np.unique(mine[:, t] >> CODE_BITS).tolist():
                        here = mine[:, t] >> CODE_BITS == number
                        least[here] = np.minimum(least[here], self.shares(full[place : place + 1], t, shapes[number // self.tables][0], mine[here, t] & ((1 << CODE_BITS) - 1)))
                needs.append(least)
        needs = np.sort(np.concatenate(needs))
        return float(needs[min(len(needs) - 1, math.ceil(recall * len(needs)) - 1)])

    def shares(self, unit: np.ndarray, table: int, axes: list[int], code: np.ndarray) -> np.ndarray:
        """The share of cells that a query probes up to each code, itself included."""
        score, total = np.zeros(len(code)), np.zeros(1)
        left = code.copy()
        digits = []
        for m in reversed(axes):
            digits.append(left % (2 * m))
            left //= 2 * m
        for level, (m, digit) in enumerate(zip(axes, reversed(digits), strict=True)):
            s = signed(turned(unit, table, level), m)[0]
            score += s[digit]
            last, before = (s, total) if level == len(axes) - 1 else (None, None)
            if last is None:
                total = (total[:, None] + s).ravel()
        if not axes:
            return np.ones(len(code))
        last = np.sort(last)
        ahead = np.array([(len(last) - np.searchsorted(last, x - before + 1e-12, "right")).sum() for x in score.tolist()])
        return (ahead + 1) / math.prod(2 * m for m in axes)

    def probes(self, asking: DataFrame, share: float, of: int) -> DataFrame:
        """(c, v, cell) of the cells that each asking class probes in the first `of` tables."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, rows, _, unit, _ in scaled(batch.column("v")):
                    mine = [(number, axes, self.wanted(axes, share)) for (d2, _), (number, axes, _) in self.shapes.items() if d2 == d]
                    most = max(want * 2 * max(axes, default=1) for _, axes, want in mine)
                    for at in range(0, len(rows), step := max(1, 4_000_000 // most)):
                        full = raised(unit[at : at + step])
                        part = batch.take(pa.array(rows[at : at + step]))
                        cells = np.concatenate([self.cell_keys(number, t, probe_order(full, t, axes, want)) for number, axes, want in mine for t in range(of)], axis=1)
                        to = pa.array(np.arange(len(full) + 1, dtype=np.int32) * cells.shape[1])
                        yield pa.RecordBatch.from_arrays([part.column("c"), part.column("v"), pa.ListArray.from_arrays(to, pa.array(cells.ravel()))], ["c", "v", "cells"])

        source = asking.select("c", "v")
        made = T.StructType([*source.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
        return source.mapInArrow(probe, made).select("c", "v", F.explode("cells").alias("cell"))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "classes"}


def _judged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best candidates of a sorted run of units; in a unit its vectors come before its queries."""
    unit, cands, vectors = None, None, None
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def matrix(batch: pa.RecordBatch, at: int, to: int) -> np.ndarray:
        column = batch.column("v").slice(at, to - at)
        return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(to - at, -1)

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, score = (np.concatenate(x) for x in zip(*waiting, strict=True))
        zero = np.zeros(len(q), np.int64)
        # classes that tie with the k-th stay, so that the smaller id can win later
        best = best_of(q, c, score, zero, zero, len(q))
        q, c, score = q[best], c[best], score[best]
        starts = K.segments(q)
        lengths = np.diff(starts, append=len(q))
        least = np.repeat(np.where(lengths >= k, score[np.minimum(starts + k - 1, len(q) - 1)], -np.inf), lengths)
        stay = score >= least
        return q[stay], c[stay], score[stay]

    def out(x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2])], _HITS.names)

    for batch in batches:
        cell, piece, kind, c = (batch.column(x).to_numpy() for x in ("cell", "piece", "kind", "c"))
        cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (piece[1:] != piece[:-1]) | (kind[1:] != kind[:-1])]))
        for at, to in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
            here = int(cell[at]), int(piece[at])
            if here != unit:
                unit, cands, vectors = here, np.zeros(0, np.int64), None
            if kind[at] == 0:
                new = matrix(batch, at, to)
                cands, vectors = np.concatenate([cands, c[at:to]]), new if vectors is None else np.concatenate([vectors, new])
                continue
            if vectors is None:
                continue
            queries = matrix(batch, at, to)
            for low in range(0, len(queries), 512):
                part = queries[low : low + 512]
                i, j = strongest(part, vectors, k)
                waiting.append((c[at:to][low + i], cands[j], products(part[i], vectors[j])))
                size += len(i)
            if size > 400_000:
                x = merged()
                if len(x[0]) > 200_000:
                    yield out(x)
                    waiting, size = [], 0
                else:
                    waiting, size = [x], len(x[0])
    if waiting:
        yield out(merged())
