"""Shards by vector bin packing: bytes, words and rows are balanced jointly.

Equal texts are a group and stay together. Groups with more than 1/`bundles` of any total are items by
themselves (at most 3 * bundles of them); all others are dealt by their hash into `bundles` items. The
items, a bounded number at every size, are placed in falling order, each in the shard where the dot
product of its sizes with the residual capacities is highest, among those with bytes left for it. Only a group larger than a shard's
capacity is cut, its rows dealt in turn. Slots and turns are counted in cells of about `cell_rows` rows,
so no task gathers a shard or a group.

Null texts are a group of their own, with size 1, no words and checksum 0. Each row gets a slot of
its own, also where its id is null or repeated. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm import shared

WORD = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each item (rows) of sizes (columns): of those with bytes (the first column) left for it, that of
    the largest dot product with what is left; where none has, that with the most bytes left."""
    total = np.maximum(items.sum(axis=0), 1e-12)
    share = items / total
    left = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1))):
        fits = left[:, 0] >= share[i, 0] - 1e-12
        s = int(np.argmax(np.where(fits, left @ share[i], -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        out[i] = s
        left[s] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", bundles: int = 4096, cell_rows: int = 50_000) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null)."""
    spark = docs.sparkSession
    text = F.col(text_col)
    table = shared.numbered(docs, "__row", "pack-texts").select(
        F.col("__row").alias("row"),
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.xxhash64(text, text.isNull()).alias("g"),
    )
    table = shared.keep(table, "pack-rows")
    groups = shared.keep(table.groupBy("g").agg(F.sum("size").alias("b"), F.sum("words").alias("w"), F.count("*").alias("r")), "pack-groups")
    total = groups.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("r").alias("r")).first()
    n_rows = total.r or 0
    big = (F.col("b") * bundles > int(total.b or 0)) | (F.col("w") * bundles > int(total.w or 0)) | (F.col("r") * bundles > n_rows)
    heavy = groups.where(big).orderBy("g").collect()
    light = groups.where(~big).groupBy(F.pmod("g", F.lit(bundles)).alias("k")).agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("r").alias("r")).orderBy("k").collect()

    # items: (key, piece, pieces, sizes); a group beyond a shard's capacity is cut into pieces
    items: list[tuple[int, bool, int, int]] = []
    sizes: list[tuple[float, float, float]] = []
    for x in heavy:
        share = max(x.b / max(total.b, 1), x.w / max(total.w or 0, 1), x.r / max(n_rows, 1))
        pieces = int(np.ceil(share * shards * 2)) if share * shards > 1 else 1
        for p in range(pieces):
            items.append((x.g, True, p, pieces))
            sizes.append((x.b / pieces, x.w / pieces, x.r / pieces))
    for x in light:
        items.append((x.k, False, 0, 1))
        sizes.append((x.b, x.w, x.r))
    where = place(np.array(sizes, float).reshape(-1, 3), shards)

    whole = spark.createDataFrame([(g, pieces) for g, is_heavy, p, pieces in items if is_heavy and p == 0], "g long, pieces int")
    chosen = spark.createDataFrame([(g, h, p, int(s)) for (g, h, p, _), s in zip(items, where, strict=True)], "key long, heavy boolean, piece int, shard int")
    # both hold at most a few rows a bundle
    told = table.join(F.broadcast(whole), "g", "left").withColumn("pieces", F.coalesce("pieces", F.lit(0)))
    cell = F.pmod(F.xxhash64("row"), F.lit(max(16, n_rows // cell_rows + 1)))

    def turns(rows: DataFrame, *key: str) -> DataFrame:
        """rows with `turn`, their number from 0 among those of a key, counted in cells."""
        rows = rows.withColumn("cell", cell)
        sums = rows.groupBy(*key, "cell").agg(F.count("*").alias("n"))
        before = sums.select(*key, "cell", (F.sum("n").over(Window.partitionBy(*key).orderBy("cell")) - F.col("n")).alias("before"))
        rank = F.row_number().over(Window.partitionBy(*key, "cell").orderBy("row"))
        return rows.withColumn("rank", rank).join(before, [*key, "cell"]).withColumn("turn", F.col("before") + F.col("rank") - 1).drop("cell", "rank", "before")

    dealt = turns(told.where("pieces > 1"), "g").withColumn("piece", (F.col("turn") % F.col("pieces")).cast("int")).drop("turn")
    told = told.where("pieces <= 1").withColumn("piece", F.lit(0)).unionByName(dealt)
    told = told.withColumn("heavy", F.col("pieces") > 0).withColumn("key", F.when(F.col("pieces") > 0, F.col("g")).otherwise(F.pmod("g", F.lit(bundles))))
    placed = told.join(F.broadcast(chosen), ["key", "heavy", "piece"]).select("row", "id", "size", "text_crc32", "shard")
    return turns(placed, "shard").select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("turn").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
