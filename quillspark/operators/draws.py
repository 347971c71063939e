"""Draws of bounded size: the first k rows of each group without a group in one place.

Every task keeps at most k rows of a group, and such lists merge into one; a group that holds a third of all
rows costs each task k rows. Quotas, round robins and panels are made of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.splits import hash_order


#: Bytes of rows that a worker gathers before it cuts them.
HELD_BYTES = 16 << 20


class ShortDraw(ValueError):
    """A category or tag has fewer rows than are wanted."""


def _least(table: pa.Table, group: list[str], order: list[str], k: str) -> pa.Table:
    """The first rows of each group, as many as its k says."""
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*group, *order)], null_placement="at_start"))
    n = table.num_rows
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for c in group:
        code = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(fresh)
    place = np.arange(n) - np.repeat(starts, np.diff(starts, append=n))
    return table.filter(pa.array(place < table[k].to_numpy()))


def _least_of(batches: Iterator[pa.RecordBatch], group: list[str], order: list[str], k: str) -> Iterator[pa.RecordBatch]:
    """The first rows of each group of all batches; what is held is cut when its rows or bytes have twice passed what must stay."""
    held, rows_kept, bytes_kept = None, 0, 0
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows > 2 * rows_kept + 20_000 or held.nbytes > 2 * bytes_kept + HELD_BYTES:
            held = _least(held, group, order, k)
            rows_kept, bytes_kept = held.num_rows, held.nbytes
    if held is not None:
        yield from _least(held, group, order, k).to_batches()


def first_of_groups(rows: DataFrame, group: list[str], order: list[str], k: int | Column, *, deals: int = 16) -> DataFrame:
    """The first k rows of each group in ascending order (nulls first); k may be a column that a group's rows share.

    Group and order columns must be of simple types. Ties are taken in any order. Null groups are groups.
    """
    rows = rows.withColumn("__k", (k if isinstance(k, Column) else F.lit(k)).cast("long"))
    schema = rows.schema

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _least_of(batches, group, order, "__k")

    part = rows.mapInArrow(least, schema)
    dealt = part.repartition(*group, F.pmod(F.xxhash64(*order), F.lit(deals))).mapInArrow(least, schema)
    return dealt.repartition(*group).mapInArrow(least, schema).drop("__k")


def quota_draw(rows: DataFrame, category: str, prompt: str, key: str, quotas: dict[str, int], *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows drawn, counts): of each category's distinct prompts the first ones in hashed order, up to its quota.

    Of rows with one prompt in a category the first in that order stands for it. Counts have each category's
    target, what was drawn and how many rows there are; a category that falls short raises ShortDraw where
    strict. Categories without a quota take no part.
    """
    wanted = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    x = rows.where(F.col(category).isin(list(quotas))).withColumn("__order", hash_order(F.col(key)))
    one = x.groupBy(category, prompt).agg(F.min_by(F.struct(*x.columns), F.struct("__order", key)).alias("x"), F.count("*").alias("__rows")).select("x.*", "__rows")
    sizes = one.groupBy(category).agg(F.count("*").alias("__distinct"), F.sum("__rows").alias("available"))
    target = rows.sparkSession.createDataFrame(sorted(quotas.items()), f"{category} string, target long")
    counts = target.join(sizes, category, "left").select(category, "target", F.least("target", F.coalesce("__distinct", F.lit(0))).alias("actual"), F.coalesce("available", F.lit(0)).alias("available"))
    if strict:
        short = counts.where("actual < target").orderBy(category).collect()  # a row a quota at most
        if short:
            raise ShortDraw("; ".join(f"{r[0]}: {r.actual} of {r.target}" for r in short))
    drawn = first_of_groups(one.drop("__rows"), [category], ["__order", key], wanted[F.col(category)])
    return drawn.drop("__order"), counts


def round_robin(rows: DataFrame, category: str, key: str, count: int) -> DataFrame:
    """`count` rows taken in turns from the categories by name, each in hashed order, with the turn from 1.

    The number of whole turns follows from the categories' sizes, so each category's share is known before a
    row is looked at. Raises ShortDraw where there are fewer rows.
    """
    sizes = {r[0]: r.n for r in rows.groupBy(category).agg(F.count("*").alias("n")).collect()}  # a row a category
    if sum(sizes.values()) < count:
        raise ShortDraw(f"{sum(sizes.values())} of {count}")
    low, high = 0, count
    while low < high:  # the most whole turns that take no more than count rows
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(n, mid) for n in sizes.values()) <= count else (low, mid - 1)
    left = count - sum(min(n, low) for n in sizes.values())
    share = {c: min(n, low) for c, n in sizes.items()}
    for c in sorted(c for c, n in sizes.items() if n > low)[:left]:
        share[c] += 1
    wanted = F.create_map(*(F.lit(x) for c in sorted(share) for x in (c, share[c])))
    x = rows.withColumn("__order", hash_order(F.col(key)))
    drawn = first_of_groups(x, [category], ["__order", key], wanted[F.col(category)])
    per = drawn.groupBy(category).agg(F.array_sort(F.collect_list(F.struct("__order", *(c for c in x.columns if c != "__order")))).alias("x"))  # `count` rows in all
    return per.select(F.posexplode("x").alias("turn", "x")).select("x.*", (F.col("turn") + 1).cast("long").alias("turn")).drop("__order")


def dev_panel(rows: DataFrame, text: str, tags: str, cover: list[str], n: int, *, each: int = 10, preferred: Column | None = None) -> DataFrame:
    """n rows with distinct texts and their place: for each tag of `cover` in turn its first `each` rows, then any.

    The order is hashed by text, preferred rows first; a row that an earlier tag took isn't taken again. Raises
    ShortDraw where there are fewer than n rows or a tag has none.
    """
    x = rows.withColumn("__order", F.concat(F.when(preferred, "0").otherwise("1") if preferred is not None else F.lit("1"), hash_order(F.col(text))))
    one = x.groupBy(text).agg(F.min_by(F.struct(*x.columns), "__order").alias("x")).select("x.*")
    tagged = one.select("*", F.explode(F.array_intersect(tags, F.array(*map(F.lit, cover)))).alias("__tag"))
    first = first_of_groups(tagged.select(text, "__order", "__tag"), ["__tag"], ["__order", text], each).collect()  # `each` rows a tag
    found = {t: [] for t in cover}
    for r in sorted(first, key=lambda r: (r["__order"], r[text])):
        found[r["__tag"]].append(r[text])
    empty = [t for t in cover if not found[t]]
    if empty:
        raise ShortDraw(f"no rows for {', '.join(empty)}")
    chosen = list(dict.fromkeys(r for t in cover for r in found[t]))[:n]
    more = one.where(~F.col(text).isin(chosen)).orderBy("__order", text).limit(n - len(chosen)).select(text).collect() if len(chosen) < n else []
    chosen += [r[0] for r in more]
    if len(chosen) < n:
        raise ShortDraw(f"{len(chosen)} of {n}")
    places = rows.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(chosen)], f"{text} string, place long")
    return one.drop("__order").join(F.broadcast(places), text)  # n rows
