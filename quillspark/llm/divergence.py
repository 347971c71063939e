"""Divergence of each source from the others of its language, by inclusion and exclusion over supports.

Of a language with V kept terms, group g (a source) prices a term of count c at
p_g(c) = 1 + floor(10^9 * (c + 5) / (N_g + 5 V)), and z_g = p_g(0). The sum of |p_g - p_h| over all kept terms
is taken from the supports alone, without a row for each absent term:

* one-sided: each group's histogram of counts prices its whole support against the other's constant z;
* both zero: (V - |S_g| - |S_h|) |z_g - z_h|, which counts the overlap once too often;
* overlap: a join of the posting lists adds |p_g - p_h| - |p_g - z_h| - |p_h - z_g| + |z_g - z_h| for each
  term that both hold.

Terms are counted in one map over the texts: a block of about `block` distinct (group, term) sends a row for
each with its occurrences and documents, so a hot source or a frequent word costs a row a block. Prices are
exact: decimals of 38 digits, divided whole.

What grows: the result has a row for each ordered pair of a language's sources, and the posting join a row for
each kept term and unordered pair that holds it. Groups of a language are broadcast below `few` of them.

Null text, language and source are the empty string; ids aren't read, each row is a document, repeated rows
count each. Groups without a kept term take part. With V = 0 all pairs are at 0 and there are no terms. An
empty table gives no rows. Terms are told apart by 64-bit hashes within a block (two of a million share one
with a chance of 3e-8) and by their text beyond it. Columns are picked by name; others are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared

U64 = np.uint64
UNIT = 1_000_000_000
PRIOR = 5
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct tuples of the keys, and the values added up by them."""
    if not len(keys[0]):
        return keys, values
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    cut = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return [k[cut] for k in keys], [np.add.reduceat(v[order], cut) for v in values]


def _terms(data: np.ndarray, offsets: np.ndarray, spelt: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, occurrences) of each row's distinct terms; spelt gets the terms of new keys."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))]
    for at, to in K.cuts(data, offsets, _TERM):
        first, last = K.spans(data, offsets, at, to, _TERM)
        if not len(first):
            continue
        lower = K._LOWER[data[at:to]]
        power, inverse = K.powers(to - at + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(to - at + 1, U64)
            np.cumsum((lower.astype(U64) + U64(1)) * power[: to - at], out=total[1:])
            key = K.mix((total[last] - total[first]) * inverse[first])
        for k, i in zip(*(x.tolist() for x in np.unique(key, return_index=True)), strict=True):
            if k not in spelt:
                spelt[k] = lower[first[i] : last[i]].tobytes()
        row = np.searchsorted(offsets, first + at, "right") - 1
        (row, key), (times,) = _summed([row, key], [np.ones(len(key), np.int64)])
        parts.append((row, key, times))
    row, key, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    (row, key), (times,) = _summed([row, key], [times])  # a long row is cut into runs
    return row, key, times


class _Block:
    """Occurrences and documents of (group, term) of a run of rows."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.spelt: dict[int, bytes] = {}
        self.keys = [np.zeros(0, np.int64), np.zeros(0, U64)]  # group, term
        self.values = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # occurrences, documents

    def add(self, batch: pa.RecordBatch) -> None:
        named = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in named], np.int64)
        row, key, times = _terms(*K.buffers(batch.column("text")), self.spelt)
        new = _summed([group[row], key], [times, np.ones(len(row), np.int64)])
        self.keys, self.values = _summed(*([np.concatenate(x) for x in zip(a, b, strict=True)] for a, b in zip((self.keys, self.values), new, strict=True)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The counts, and a row with the empty term for each group."""
        names = list(self.groups)
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        zero = pa.array(np.zeros(len(names), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.array([""] * len(names), pa.string()), zero, zero], _COUNTS.names)
        for at in range(0, len(self.keys[0]), 50_000):
            group, key, n, docs = (x[at : at + 50_000] for x in (*self.keys, *self.values))
            term = pa.array([self.spelt[k] for k in key.tolist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(group)), source.take(pa.array(group)), term, pa.array(n), pa.array(docs)], _COUNTS.names)


def term_counts(table: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs) of all texts, written; each group has a row with the empty term too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Block()
        for batch in K.pieces(batches, "text"):
            held.add(batch)
            if len(held.keys[0]) > block:
                yield from held.rows()
                held = _Block()
        if held.groups:
            yield from held.rows()

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    parts = table.select(*filled).mapInArrow(count, _COUNTS)
    return shared.keep(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def price(n, total, kept):
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) in whole decimals; 1 where nothing is kept."""
    share = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"), (total + PRIOR * kept).cast("decimal(20,0)"))
    return F.when(kept > 0, share + 1).otherwise(1).cast("long")


def divergence(table: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50, few: int = 1_000_000) -> DataFrame:
    """Per group and part: lang, source, part (pair or term), item, value and rank."""
    spark = table.sparkSession
    counts = term_counts(table, text_col=text_col, lang_col=lang_col, source_col=source_col)
    words = counts.where("term <> ''")
    kept = shared.keep(words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = shared.keep(words.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = groups.withColumns({"zero": price(F.lit(0), F.col("total"), F.col("kept")), "lang_zero": price(F.lit(0), F.col("lang_total"), F.col("kept"))})
    groups = shared.keep(groups, "groups")
    small = groups.count() <= few

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    priced = held.join(sent(groups), ["lang", "source"]).select("lang", "source", "term", "zero", price(F.col("n"), F.col("total"), F.col("kept")).alias("p"), price(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    priced = shared.keep(priced, "priced")

    # one-sided: a group's histogram of prices against the constants of the language's other groups
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    one_sided = histogram.join(sent(other.select("lang", "item", "other_zero")), "lang").where("source <> item")
    one_sided = one_sided.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("other_zero"))).alias("one_sided"))

    # overlap: posting lists joined with themselves, each unordered pair once
    mine, theirs = priced.select("lang", "term", "source", "p", "zero"), priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("zero").alias("item_zero"))
    p, z, ip, iz = (F.col(c) for c in ("p", "zero", "item_p", "item_zero"))
    both = mine.join(theirs, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(p - ip) - F.abs(p - iz) - F.abs(ip - z) + F.abs(z - iz)).alias("overlap"))

    # each ordered pair's parts are added up by key, so no pair waits for a join of the three
    pairs = groups.select("lang", "source", "zero", "support", "kept").join(sent(other), "lang").where("source <> item")
    zeros = pairs.select("lang", "source", "item", ((F.col("kept") - F.col("support") - F.col("other_support")) * F.abs(F.col("zero") - F.col("other_zero"))).alias("value"))
    swapped = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))

    def both_ways(df: DataFrame, column: str) -> DataFrame:
        return df.select("lang", swapped.alias("x"), F.col(column).alias("value")).select("lang", "x.source", "x.item", "value")

    value = zeros.unionByName(both_ways(one_sided, "one_sided")).unionByName(both_ways(both, "overlap"))
    value = value.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_rows = value.withColumn("rank", F.row_number().over(order))
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    # a group's best of each deal, then its best of all
    deal = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))).orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(deal)).where(F.col("rank") <= top).drop("rank")
    term_rows = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_rows.select(*columns).unionByName(term_rows.select(*columns))
