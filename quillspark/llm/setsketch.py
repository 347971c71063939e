"""Near-duplicate documents by SetSketch registers: banded, jointly estimated, then verified on full sets.

A document's set holds its distinct 5-word shingles. Register i of its sketch is
K_i = clip(floor(1 - log_b(min h_i)), 0, q + 1), where h_i are exponential hashes of rate a; the maximum
of two sketches is the sketch of the union, and equal registers are likelier the more alike two sets are.

1. One pass over the texts makes sizes, set fingerprints, registers and band keys.
2. Documents with one set are a class, whatever their ids; its number stands for it from here on.
3. Classes that share a band (`rows` registers) meet the smallest class of their bucket (a star, linear in
   the bucket); pairs whose registers' joint likelihood rules the threshold out are dropped; the rest
   are verified on full sets, and links are joined to components. A star with very many members is dealt
   over several tasks.
4. Where a bucket still holds several components, those outside its commonest one are its outsiders. While
   comparing all of them would be much work and it helps, an outsider becomes the next star's centre.
   Then each chunk of outsiders meets each chunk of its bucket's members: an inverted index of the full
   sets counts what an outsider shares with members of other components. Components that meet are one
   from then on in the unit, so a unit gives fewer links than it has rows, and no connection in a bucket
   is lost to the stars. A chunk holds at most `chunk` classes and about `mass` shingles.

A link is missed only where no band matches; the number of bands keeps that under `miss` at the
threshold (20 bands of 4 registers at 0.85).

Nulls and texts without words have the empty set and link with nothing; one to four words are one
shingle. Each row is a document, also where its id is null or repeated: of a component one row is kept, a row
of the smallest id (any of them where rows repeat that id; any row where all ids are null, and then
component_id is null). An empty table gives none.
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
BASE, RATE, LIMIT = 1.02, 20.0, (1 << 12) - 2
SMALL_ROWS = 1_000_000


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = K.mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (a >> U64(32)).astype(np.uint32), (a.astype(np.uint32) | np.uint32(1))


def shingles(keys: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams in order (shorter rows: the whole), and row offsets."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts = K.ranges(offsets[:-1], count)
    width = np.repeat(np.minimum(n, size), count)
    out = np.full(len(starts), U64(size), U64)
    with np.errstate(over="ignore"):
        for i in range(size):
            inside = i < width
            at = np.where(inside, starts + i, 0)
            out = out * U64(0x9FB21C651E98DF25) + np.where(inside, keys[at] if len(keys) else 0, U64(0x632BE59BD9B4E019))
            out ^= out >> U64(29)
    return K.mix(out), np.concatenate([[0], np.cumsum(count)])


def registers(hashes: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """m registers for each row, (rows, m); rows without elements get 0."""
    rows = len(offsets) - 1
    out = np.zeros((rows, m), np.uint16)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    salt, odd = _seeds(m)
    x = (hashes >> U64(32)).astype(np.uint32)
    low = np.empty((len(full), m), np.uint32)
    # rows in runs of about 64k elements, which stay in the cache
    cuts = np.flatnonzero(np.diff(offsets[full] // 65536, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(full)], strict=True):
        begin, end = offsets[full[i]], offsets[full[j - 1] + 1]
        part, at = x[begin:end], offsets[full[i:j]] - begin
        for r in range(m):
            y = (part ^ salt[r]) * odd[r]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            low[i:j, r] = np.minimum.reduceat(y, at)
    h = -np.log1p(-(low.astype(float) + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    return out


def prints(own: np.ndarray) -> tuple[int, int, int]:
    """The fingerprint of a set of distinct hashes: its size, sum and exclusive or."""
    if not len(own):
        return 0, 0, 0
    return len(own), int(own.sum(dtype=U64).view(np.int64)), int(np.bitwise_xor.reduce(own).view(np.int64))


def likelihood(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, equal: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j, from how many registers of a are above, below and equal to b's."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * j), p(v - u * j)
    return above * np.log(more) + below * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))


def plausible(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, margin: float = 18.0) -> np.ndarray:
    """Whether the best likelihood at or over the threshold is within `margin` (6 sigma) of the best of all."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.concatenate([np.linspace(0, threshold, 25)[:-1], np.linspace(threshold, 1, 7)])
    best = np.full(len(n_a), -np.inf)
    over = np.full(len(n_a), -np.inf)
    for g in grid:
        value = likelihood(n_a, n_b, above, below, equal, np.minimum(g, most))
        best = np.maximum(best, value)
        if g >= threshold:
            over = np.maximum(over, value)
    return (most >= threshold - 1e-9) & (over >= best - margin)


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    data, _ = K.buffers(column)
    return np.frombuffer(data.tobytes(), "<u2").reshape(-1, m)


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
            key = tuple(c[i] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _across(unit: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a unit, i an outsider, whose links join its components: as few as that takes, whatever their pairs."""
    own = [K.unpack_sorted(x.as_py())[0] for x in unit["words"]]
    n = np.array([len(x) for x in own])
    c = np.unique(unit["c"].to_numpy(), return_inverse=True)[1]
    outside = np.array(unit["outside"].to_pylist(), bool)
    queries, members = np.flatnonzero(outside), np.flatnonzero(~outside)
    if not len(queries) or not len(members) or c.max() == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, where = np.unique(np.concatenate([own[i] for i in members]), return_inverse=True)
    order = np.argsort(where, kind="stable")
    posting, begin = np.repeat(members, n[members])[order], np.searchsorted(where[order], np.arange(len(words) + 1))
    a, b = [], []
    for i in queries:
        at = np.minimum(np.searchsorted(words, own[i]), len(words) - 1)
        at = at[words[at] == own[i]]
        both = np.bincount(posting[K.ranges(begin[at], begin[at + 1] - begin[at])], minlength=len(own))
        hit = np.flatnonzero((c != c[i]) & (both * 100 >= percent * (n + n[i] - both)) & (both > 0))
        if len(hit):
            met, first = np.unique(c[hit], return_index=True)
            a.append(np.full(len(hit[first]), i))
            b.append(hit[first])
            c[np.isin(c, met)] = c[i]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5, rows: int = 4, miss: float = 4e-7, chunk: int = 1024, mass: int = 1 << 20) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links) and kept.

    Two documents are linked where 100 * |intersection| >= percent * |union| on their full sets.
    """
    bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
    m = bands * rows
    id_type = docs.schema[id_col].dataType
    docs = shared.numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row", "near-texts")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, "text"):
            keys, offsets = K.words(batch.column("text"))
            hashes, offsets = shingles(keys, offsets, size)
            n = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((batch.num_rows, 2), np.int64)
            for i in range(batch.num_rows):
                own = K.distinct(hashes[offsets[i] : offsets[i + 1]])
                n[i], sums[i, 0], sums[i, 1] = prints(own)
            regs = registers(hashes, offsets, m)
            keys = np.zeros((batch.num_rows, bands), U64)
            for b in range(bands):
                k = np.full(batch.num_rows, U64(b + 1))
                for r in range(rows):
                    k = K.fold(k, regs[:, b * rows + r].astype(U64))
                keys[:, b] = k
            count = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("row"),
                    pa.array(n),
                    pa.array(sums[:, 0]),
                    pa.array(sums[:, 1]),
                    pa.BinaryArray.from_buffers(pa.binary(), count, [None, pa.py_buffer((np.arange(count + 1) * 2 * m).astype(np.int32)), pa.py_buffer(regs.astype("<u2").tobytes())]),
                    pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                ],
                ["id", "row", "n", "s1", "s2", "regs", "bands"],
            )

    schema = T.StructType([T.StructField("id", id_type), docs.schema["row"], T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("regs", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    same = ["n", "s1", "s2"]
    drawn = shared.keep(docs.mapInArrow(sketch, schema), "near-sketches")
    some = drawn.where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("first")
    # classes are numbered as they are written, so the numbers hold from then on
    classes = some.groupBy(*same).agg(first, F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    classes = shared.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "near-classes")

    placed = classes.select("rep", "n", F.explode("bands").alias("band"))
    pivots = placed.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    pivots = shared.keep(pivots, "near-pivots")
    hot_bands = shared.hot_of(pivots, ["band"], "members", classes.count() * bands)
    members = shared.keep(shared.spread_join(placed, pivots, ["band"], hot_bands, ["rep"]), "near-members")
    slim = classes.select("rep", "n", "regs")
    pair_type = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def sets_of(wanted: DataFrame, packed: bool = False) -> DataFrame:
        """(id, words): the full sets of the wanted classes, as arrays or packed."""
        wanted = shared.keep(classes.join(wanted, F.col("rep") == wanted["id"], "left_semi").select("first.row", "rep"), "near-wanted")
        few = wanted.count() <= SMALL_ROWS
        chosen = docs.select("row", "text").join(F.broadcast(wanted) if few else wanted, "row").select("rep", "text")

        def sets(batches):
            for batch in K.pieces(batches, "text"):
                keys, offsets = K.words(batch.column("text"))
                hashes, offsets = shingles(keys, offsets, size)
                own = [K.distinct(hashes[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
                if packed:
                    words = pa.array([K.pack_sorted(x) for x in own], pa.binary())
                else:
                    values = np.concatenate(own) if own else np.zeros(0, U64)
                    words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), words], ["id", "words"])

        kind = T.BinaryType() if packed else T.ArrayType(T.LongType())
        return shared.keep(chosen.mapInArrow(sets, T.StructType([T.StructField("id", T.LongType()), T.StructField("words", kind)])), "near-sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), a the centres of stars, those linked by their full sets; registers rule most others out."""
        left = slim.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        right = slim.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

        def test(batches):
            for x in batches:
                ok = plausible(x.column("na").to_numpy().astype(float), x.column("nb").to_numpy().astype(float), _matrix(x.column("ra"), m), _matrix(x.column("rb"), m), percent / 100)
                yield x.select(["a", "b"]).filter(pa.array(ok))

        pairs = shared.keep(pairs.distinct(), "near-pairs")
        met = shared.spread_join(pairs, left, ["a"], shared.hot_keys(pairs, "a"), ["b"]).join(right, "b")
        likely = shared.keep(met.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(test, pair_type), "near-stars")
        found = sets_of(likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct())
        both = shared.spread_join(likely, found.select(F.col("id").alias("a"), F.col("words").alias("wa")), ["a"], shared.hot_keys(likely, "a"), ["b"])
        both = both.join(found.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        shared_n = F.size(F.array_intersect("wa", "wb"))
        both = both.select("a", "b", shared_n.alias("i"), (F.size("wa") + F.size("wb")).alias("t"))
        return shared.keep(both.where(F.col("i") * 100 >= percent * (F.col("t") - F.col("i"))).select("a", "b"), "near-links")

    def mixed_buckets(labels: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        """Members with their components; buckets of several, with the commonest; (outsiders, units' rows)."""
        tagged = members.select("band", "rep", "n").join(labels, members["rep"] == labels["node"], "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("c"))
        tagged = shared.keep(tagged, "near-tagged")
        sizes = tagged.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("n").alias("mass"))
        top = sizes.groupBy("band").agg(F.max(F.struct("n", "c", "mass")).alias("top"), F.sum("n").alias("members"), F.sum("mass").alias("mass"), F.count("*").alias("parts")).where("parts > 1")
        cuts = lambda n, of: F.greatest(F.ceil(n / chunk), F.ceil(of / mass)).cast("int")
        outside = F.col("members") - F.col("top.n")
        mixed = top.select("band", F.col("top.c").alias("common"), "members", outside.alias("outside"), cuts(outside, F.col("mass") - F.col("top.mass")).alias("queries"), cuts(F.col("members"), F.col("mass")).alias("cut"))
        mixed = shared.keep(mixed, "near-mixed")
        least = mixed.agg(F.sum("outside").alias("u"), F.sum(F.col("queries") * F.col("members") + F.col("cut") * F.col("outside")).alias("w")).first()
        return tagged, mixed, (least.u or 0, least.w or 0)

    links = linked(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    labels = components(links, shared.keep)
    tagged, mixed, (outside, work) = mixed_buckets(labels)
    many, turn = members.count(), 0
    while work > many:
        turn += 1
        there = shared.spread_join(tagged, mixed, ["band"], hot_bands, ["rep"])
        centres = there.where("c <> common").groupBy("band").agg(F.min_by(F.struct("rep", "c"), F.xxhash64("rep", F.lit(turn))).alias("p")).select("band", F.col("p.rep").alias("a"), F.col("p.c").alias("ac"))
        pairs = shared.spread_join(tagged, centres, ["band"], hot_bands, ["rep"]).where("c <> ac").select("a", F.col("rep").alias("b"))
        links = links.union(linked(pairs))
        labels = components(links, shared.keep)
        before = outside
        tagged, mixed, (outside, work) = mixed_buckets(labels)
        if outside * 4 > before * 3:
            break
    if work:
        there = shared.spread_join(tagged, mixed, ["band"], hot_bands, ["rep"])
        queries, parts = F.col("queries"), F.col("cut")
        asks = there.where("c <> common").select("band", "rep", "c", F.lit(True).alias("outside"), F.pmod(F.xxhash64("rep", "band"), queries).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
        held = there.select("band", "rep", "c", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), queries - 1)).alias("q"), F.pmod(F.xxhash64("rep", "band", F.lit(1)), parts).cast("int").alias("p"))
        rest = shared.keep(asks.unionByName(held), "near-rest")
        words = sets_of(rest.select(F.col("rep").alias("id")).distinct(), packed=True).withColumnRenamed("id", "rep")
        count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shared.buckets(rest, 1 << 18, 1))
        carried = shared.spread_join(rest, words, ["rep"], shared.hot_keys(rest, "rep"), ["band", "q", "p"])
        carried = carried.repartition(count, "band", "q", "p").sortWithinPartitions("band", "q", "p")

        def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for unit in _units(batches, ["band", "q", "p"]):
                a, b = _across(unit, percent)
                yield pa.RecordBatch.from_arrays([unit["rep"].combine_chunks().take(pa.array(x)) for x in (a, b)], ["a", "b"])

        extra = shared.keep(carried.select("band", "q", "p", "rep", "c", "outside", "words").mapInArrow(resolve, pair_type).distinct(), "near-extra")
        if not extra.isEmpty():
            labels = components(links.union(extra), shared.keep)

    reps = classes.select(*same, "first", "rep").join(labels, F.col("rep") == labels["node"], "left").select(*same, "first", F.coalesce("component", "rep").alias("c"))
    reps = shared.keep(reps, "near-reps")
    heads = reps.groupBy("c").agg(F.min("first").alias("head"))
    reps = shared.spread_join(reps, heads, ["c"], shared.hot_keys(reps, "c"), same).select(*same, "head")
    out = drawn.select("id", "row", *same)
    out = shared.spread_join(out, reps, same, shared.hot_keys(some, *same), ["row"], "left")
    alone = F.col("head").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("component_id"), F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"))
