"""Near-duplicate embeddings by randomised-rotation binary codes with correction factors.

Each vector o (unit length) is turned by seeded random rotations; the signs of the turned coordinates
are its code, x = sign / sqrt(d), and the stored factor <x, o> makes <x, y> / <x, o> an unbiased
estimate of <o, y> for any unit y, with standard error sqrt(1 / <x, o>^2 - 1) / sqrt((d - 1) * turns).

0. Rows of one label and vector are a class with a count; a class counts for its members from here on.
1. Bands of code bits (more bits as the table grows, and as many bands as the wanted recall needs)
   bring vectors of one label together.
2. In a bucket, the estimate plus `sigmas` standard errors decides which pairs can reach the threshold;
   those are recomputed exactly in double precision. A pair counts in its first common band only.
3. Buckets of more than `chunk` vectors are split into chunks, and each pair of chunks is a unit of
   work of its own; units emit a row for each vector, never pairs.

Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing. Each row is a vector, also where its id is null or repeated: of a component one row is kept, a
row of the smallest id (any of them where rows repeat that id; any row where all ids are null, and then
component_id is null). Classes and labels go by hashes of 128 and 64 bits. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared
from quillspark.operators.components import components

U64 = np.uint64


def rotations(d: int, turns: int, seed: int = 20) -> np.ndarray:
    """(turns, d, d) random orthogonal matrices."""
    g = np.random.default_rng([seed, d])
    out = []
    for _ in range(turns):
        q, r = np.linalg.qr(g.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def turned(unit: np.ndarray, turns: int) -> np.ndarray:
    """(rows, turns * d) rotated coordinates."""
    d = unit.shape[1]
    return unit @ rotations(d, turns).transpose(2, 0, 1).reshape(d, turns * d)


def factors(rotated: np.ndarray, turns: int) -> np.ndarray:
    """<x, o> of each row and turn."""
    n, d = rotated.shape[0], rotated.shape[1] // turns
    return np.abs(rotated).reshape(n, turns, d).sum(axis=2) / math.sqrt(d)


def margin(factor: np.ndarray, d: int, sigmas: float) -> np.ndarray:
    turns = factor.shape[1]
    return sigmas * np.sqrt(np.mean(1 / factor**2 - 1, axis=1) / (max(d - 1, 1) * turns))


def shape_for(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits a band, bands) for n vectors: a random pair meets in a band with about 1/(4n)."""
    bits = max(10, math.ceil(math.log2(max(n, 2))) + 2)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _unit_vectors(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, unit vectors) of the usable rows."""
    n = np.array([len(x) if x is not None and x.is_valid else 0 for x in column]) if column.null_count else np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) if flat.null_count else flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = []
    for d in np.unique(n[n > 0]):
        rows = np.flatnonzero(n == d)
        v = values[K.ranges(ends[rows], np.full(len(rows), d))].reshape(-1, d)
        top = np.abs(v).max(axis=1)
        ok = np.isfinite(top) & (top > 0)
        v = v[ok] / top[ok, None]
        out.append((int(d), rows[ok], v / np.sqrt((v * v).sum(axis=1, keepdims=True))))
    return out


def _band_keys(bits: np.ndarray, width: int, bands: int) -> np.ndarray:
    """(rows, bands) keys; bit j of band b is code bit b * width + j."""
    powers = U64(1) << np.arange(width, dtype=U64)
    return (bits[:, : width * bands].reshape(-1, bands, width) * powers).sum(axis=2, dtype=U64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def near_vectors(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-5, sigmas: float = 5.0, chunk: int = 1024) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest id reachable over links) and kept."""
    v, label = F.col(vector_col), F.col(label_col).cast("string")
    wild = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(label.isNotNull() & ~wild & F.exists(v, lambda x: x != 0), F.lit(False))
    table = shared.numbered(table.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v"), F.when(fit, F.xxhash64(label, v)).alias("h1"), F.when(fit, F.xxhash64(F.lit(1), v, label)).alias("h2")), "row", "vec-rows")
    same = ["h1", "h2"]
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("first")
    classes = table.where("h1 is not null").groupBy(*same).agg(first, F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    # classes are numbered as they are written, so the numbers hold from then on
    classes = shared.keep(classes.withColumn("label", F.xxhash64("label")).withColumn("id", F.monotonically_increasing_id()), "vec-classes")
    usable = classes.select("id", "label", "v", "m")
    id_type = T.LongType()
    width, bands = shape_for(usable.count(), threshold, miss)

    def turns_for(d: int) -> int:
        return -(-width * bands // d)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, unit in _unit_vectors(batch.column("v")):
                for at in range(0, len(rows), 4096):
                    part, u = rows[at : at + 4096], unit[at : at + 4096]
                    bits = turned(u, turns_for(d)) >= 0
                    keys = _band_keys(bits, width, bands)
                    tags = batch.column("label").take(pa.array(part)).to_numpy().view(U64)
                    for b in range(bands):
                        keys[:, b] = K.fold(K.fold(keys[:, b], tags), np.full(len(part), U64(b * 100_003 + d)))
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(part)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))], ["id", "bands"])

    coded = usable.mapInArrow(code, T.StructType([T.StructField("id", id_type), T.StructField("bands", T.ArrayType(T.LongType()))]))
    placed = shared.keep(coded.select("id", F.posexplode("bands").alias("band", "bucket")), "vec-placed")
    sizes = shared.keep(placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "vec-sizes")
    hot = shared.hot_of(sizes, ["bucket"], "members", classes.count() * bands)
    # a vector goes to a unit for each chunk of its bucket, its own included
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    spread = (
        shared.spread_join(placed, sizes, ["bucket"], hot, ["id"])
        .select("id", "bucket", "band", chunks.alias("chunks"), F.pmod(F.xxhash64("id", "bucket"), chunks).cast("int").alias("own"))
        .select("id", "bucket", "band", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select("id", "bucket", "band", "own", F.least("own", "other").alias("c0"), F.greatest("own", "other").alias("c1"))
    )
    units = shared.keep(spread, "vec-units")
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), shared.buckets(units, 1 << 20, 1))
    carried = units.join(usable, "id").repartition(parts, "bucket", "c0", "c1").sortWithinPartitions("bucket", "c0", "c1")

    def judge(part: pa.Table) -> pa.RecordBatch | None:
        """Links within the units of a sorted table, counted by vector."""
        found = _unit_vectors(part["v"].combine_chunks())
        outs = []
        labels, copies = part["label"].to_numpy(), part["m"].to_numpy()
        for d, rows, unit in found:
            turns = turns_for(d)
            rotated = turned(unit, turns)
            f = factors(rotated, turns)
            # one weighted code a row: sign / (sqrt(d) * factor * turns) makes the estimate a plain product
            bits = rotated >= 0
            weighted = (np.where(bits, 1.0, -1.0).reshape(-1, turns, d) / (f[:, :, None] * math.sqrt(d) * turns)).reshape(len(rows), -1).astype(np.float32)
            rotated = rotated.astype(np.float32)
            slack = margin(f, d, sigmas) + 1e-4
            keys, band = _band_keys(bits, width, bands), part["band"].to_numpy()[rows]
            bucket, c0, c1, own = (part[x].to_numpy()[rows] for x in ("bucket", "c0", "c1", "own"))
            starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])]))
            lengths = np.diff(starts, append=len(rows))
            linked = []

            def test(i, j, unit=unit, weighted=weighted, rotated=rotated, slack=slack, keys=keys, band=band, bucket=bucket, c0=c0, c1=c1, own=own, rows=rows):
                """Of the pairs (i, j), i < j, of one unit each: those that link and count here."""
                fresh = (labels[rows[i]] == labels[rows[j]]) & ((c0[i] == c1[i]) | (own[i] != own[j]))
                i, j = i[fresh], j[fresh]
                near = np.einsum("ij,ij->i", weighted[i], rotated[j]) + slack[i] >= threshold
                i, j = i[near], j[near]
                ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[ok], j[ok]
                earlier = (keys[i] == keys[j]) & (np.arange(bands) < band[i][:, None])
                first = ~earlier.any(axis=1)
                return i[first], j[first]

            small = lengths <= 48
            s, n = starts[small], lengths[small]
            if len(s):
                left = K.ranges(s, n)
                pos = K.ranges(np.zeros(len(s), np.int64), n)
                i = np.repeat(left, pos)
                j = K.ranges(left - pos, pos)
                for at in range(0, len(i), 1 << 14):
                    linked.append(test(j[at : at + (1 << 14)], i[at : at + (1 << 14)]))
            for s, n in zip(starts[~small], lengths[~small], strict=True):
                for at in range(s, s + n, 256):
                    to = min(at + 256, s + n)
                    block = weighted[at:to] @ rotated[s : s + n].T + slack[at:to, None] >= threshold
                    i, j = np.nonzero(block)
                    i, j = i + at, j + s
                    i, j = i[i < j], j[i < j]
                    for k in range(0, len(i), 1 << 14):
                        linked.append(test(i[k : k + (1 << 14)], j[k : k + (1 << 14)]))
            i = np.concatenate([x[0] for x in linked]) if linked else np.zeros(0, np.int64)
            j = np.concatenate([x[1] for x in linked]) if linked else np.zeros(0, np.int64)
            m = copies[rows]
            counts = (np.bincount(i, m[j], len(rows)) + np.bincount(j, m[i], len(rows))).astype(np.int64)
            root = _roots(len(rows), i, j)
            some = np.flatnonzero(counts)
            ids = part["id"].combine_chunks()
            outs.append(pa.table({"id": ids.take(pa.array(rows[some])), "links": pa.array(counts[some]), "root": ids.take(pa.array(rows[root[some]]))}))
        return pa.concat_tables(outs) if outs else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 4096:
                continue
            b, x, y = (held[c].to_numpy() for c in ("bucket", "c0", "c1"))
            edge = np.flatnonzero((b[1:] != b[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            if len(edge):  # the last unit may go on
                cut = int(edge[-1]) + 1
                out = judge(held.slice(0, cut))
                held = held.slice(cut)
                if out is not None:
                    yield from out.to_batches()
        if held is not None and held.num_rows:
            out = judge(held)
            if out is not None:
                yield from out.to_batches()

    links = shared.keep(carried.select("id", "v", "label", "m", "bucket", "band", "own", "c0", "c1").mapInArrow(work, T.StructType([T.StructField("id", id_type), T.StructField("links", T.LongType()), T.StructField("root", id_type)])), "vec-links")
    labels = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), shared.keep)
    counts = links.groupBy("id").agg(F.sum("links").alias("others"))
    reps = classes.select("id", *same, "first", "m").join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    reps = shared.keep(reps.select(*same, "first", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c")), "vec-reps")
    heads = reps.groupBy("c").agg(F.min("first").alias("head"))
    reps = shared.spread_join(reps, heads, ["c"], shared.hot_keys(reps, "c"), same).select(*same, "n_links", "head")
    rows = table.select("id", "row", *same)
    out = shared.spread_join(rows, reps, same, shared.hot_keys(rows.where("h1 is not null"), *same), ["row"], "left")
    alone = F.col("head").isNull()
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"), F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"))
