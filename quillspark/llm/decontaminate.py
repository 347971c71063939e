"""Benchmark decontamination by edit distance: CGK embeddings, bit-sampling LSH, exact verification.

A document is contaminated by an item of n words where some run of its words is within
floor((1 - similarity) * n) word edits of it (words: lower-cased, ASCII punctuation taken out, by hash).

1. Only windows that can hold an occurrence are embedded: of an item within t edits, n - t words,
   n - 1 - 2t neighbouring pairs and n - 2 - 3t triples stay, so a window with fewer benchmark words,
   pairs or triples is ruled out.
2. The CGK random walk copies a window's word at each step and moves on where a random bit of (step,
   word) says so, which turns few edits into few differing steps. Each of `repeats` walks is sampled at
   `samples` steps; windows whose samples equal an item's are candidates. A window starts at every word,
   so an occurrence has several chances on each walk.
3. Walks miss the more, the longer an item is. So for items of `sure` words or more, stretches whose
   windows stay and that hold n - 2 - 3t of one item's own triples are candidates for it without a walk.
4. Candidates are confirmed by an exact bit-parallel search for the item within t edits.

So of items of `sure` words or more none is missed where n - 2 - 3t is over 0, as it is for all of them at
the default similarity. Of shorter items untouched copies are never missed; edited ones may be (in a
simulation of 7 lengths from 5 to 19 at the limit of edits, 300 passages each, none was).

The benchmark is held in memory by parts of about `part_bytes` bytes of text, one after the other, each
with a pass over the documents; usually there is one part. Several parts' finds meet by row, not by id.

Null and empty texts, and items without words, match nothing. Repeated items match alike. Each row is
a document, also where its id is null or repeated. An empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared

U64 = np.uint64


def search(item: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int]:
    """(least edits of the item against any run of text, where that run ends), or (limit + 1, -1)."""
    n = len(item)
    places: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = limit + 1, -1
    for j, c in enumerate(text.tolist()):
        eq = places.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full  # a match may start anywhere
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def embed(words: np.ndarray, starts: np.ndarray, n: int, walks: list[np.ndarray]) -> np.ndarray:
    """(walks, windows): a hash of each walk's output at its sampled steps, for the windows of n words at starts."""
    if len(starts) * len(walks) > 1 << 21 and len(starts) > 1:
        half = len(starts) // 2
        return np.concatenate([embed(words, x, n, walks) for x in (starts[:half], starts[half:])], axis=1)
    at = np.zeros((len(walks), len(starts)), np.int64)
    seed = np.arange(len(walks), dtype=U64)[:, None] << U64(20)
    out = np.repeat(np.arange(1, len(walks) + 1, dtype=U64)[:, None], len(starts), axis=1)
    wanted: dict[int, list[int]] = {}
    for w, steps in enumerate(walks):
        for x in steps.tolist():
            wanted.setdefault(x, []).append(w)
    for step in range(max(wanted, default=-1) + 1):
        word = np.where(at < n, words[np.minimum(starts + np.minimum(at, n - 1), len(words) - 1)], U64(0))
        for w in wanted.get(step, ()):
            out[w] = K.fold(out[w], word[w])
        # one random bit of (walk, step, word) moves on
        at += (K.mix(word ^ ((seed | U64(step)) * U64(0x9E3779B97F4A7C15))) >> U64(63)).astype(np.int64)
    return out


_PLAIN = np.ones(256, bool)
_PLAIN[33:48] = _PLAIN[58:65] = _PLAIN[91:97] = _PLAIN[123:127] = False


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the rows' words in lower case without ASCII punctuation, and row offsets; words of nothing else vanish."""
    data, offsets = K.buffers(pc.utf8_lower(column))
    kept = _PLAIN[data]
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int64)
    return K.words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[kept]))]))


class _Set:
    """Membership and places of keys, by a bitmap and then exactly."""

    def __init__(self, keys: np.ndarray):
        self.keys = K.distinct(keys)
        self.shift = U64(64 - max(16, min(27, len(self.keys).bit_length() + 6)))
        self.map = np.zeros(1 << (64 - int(self.shift)), bool)
        self.map[(self.keys >> self.shift).astype(np.int64)] = True

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = self.map[(keys >> self.shift).astype(np.int64)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            out[some] = self.keys[at] == keys[some]
        return out


class Finder:
    def __init__(self, ids: list, texts: list, similarity: float, repeats: int, samples: int, sure: int = 20):
        keys, offsets = plain_words(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [keys[offsets[i] : offsets[i + 1]] for i in range(len(ids))]
        by_length: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            if len(x):
                by_length.setdefault(len(x), []).append(i)
        self.edits = {n: int((1 - similarity) * n + 1e-9) for n in by_length}
        self.words = _Set(keys)
        self.pairs = _Set(np.concatenate([K.fold(x[:-1], x[1:]) for x in self.items if len(x) > 1] or [np.zeros(0, U64)]))
        self.triples = _Set(np.concatenate([K.fold(K.fold(x[:-2], x[1:-1]), x[2:]) for x in self.items if len(x) > 2] or [np.zeros(0, U64)]))
        rng = np.random.default_rng(5)
        self.tables = []
        self.members = []  # which triples the items of a length hold
        self.sure = sure
        self.holders = []  # for lengths of `sure` words or more, pairs (triple, item), sorted
        for n, mine in sorted(by_length.items()):
            flat = np.concatenate([self.items[i] for i in mine])
            at = np.arange(len(mine)) * n
            walks = [np.sort(rng.choice(max(2 * n - 2, 1), min(samples, max(2 * n - 2, 1)), replace=False)) for _ in range(repeats)]
            tables = []
            for h in embed(flat, at, n, walks):
                order = np.argsort(h, kind="stable")
                tables.append((h[order], np.array(mine)[order]))
            walks = (walks, tables)
            member, holders = np.zeros(len(self.triples.keys), bool), (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if n > 2:
                which = np.searchsorted(self.triples.keys, np.concatenate([K.fold(K.fold(x[:-2], x[1:-1]), x[2:]) for x in (self.items[i] for i in mine)]))
                member[which] = True
                if n >= sure:
                    pairs = np.unique(np.stack([which, np.repeat(mine, n - 2)]), axis=1)
                    holders = pairs[0], pairs[1]
            self.members.append(member)
            self.holders.append(holders)
            self.tables.append((n, self.edits[n], walks))
        # any window that can hold an item long enough to keep triples has `dense` of them within `short`
        # words: its triples fall into as many runs of that length as it has
        keep = [(n, t) for n, t, _ in self.tables if n - 2 - 3 * t > 0]
        self.short = min((n + t for n, t in keep), default=1)
        self.reach = max((n + t for n, t in keep), default=1)
        self.dense = min((-(-(n - 2 - 3 * t) // -(-(n + t) // self.short)) for n, t in keep), default=1)

    def _held(self, which: np.ndarray, holders: tuple[np.ndarray, np.ndarray], least: int) -> Iterator[int]:
        """The items that hold the triples of at least `least` of the places."""
        i, j = np.searchsorted(holders[0], which, "left"), np.searchsorted(holders[0], which, "right")
        items, counts = np.unique(holders[1][K.ranges(i, j - i)], return_counts=True)
        yield from items[counts >= least].tolist()

    def find(self, keys: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, end word) of every contaminated row and item; keys are the rows' words."""
        if not len(keys) or not self.tables:
            return []
        word = self.words.has(keys)
        pair = np.zeros(len(keys), bool)
        # a pair needs both words known, which few places have
        both = np.flatnonzero(word[:-1] & word[1:])
        pair[both] = self.pairs.has(K.fold(keys[both], keys[both + 1]))
        ends = offsets[1:-1]
        pair[ends[(ends > 0) & (ends <= len(keys))] - 1] = False
        words_to = np.concatenate([[0], np.cumsum(word)])
        pairs_to = np.concatenate([[0], np.cumsum(pair)])
        triple = np.zeros(len(keys), bool)
        both = np.flatnonzero(pair[:-1] & pair[1:])
        whole = K.fold(K.fold(keys[both], keys[both + 1]), keys[both + 2])
        triple[both] = self.triples.has(whole)
        hits = both[triple[both]]
        which_triple = np.searchsorted(self.triples.keys, whole[triple[both]])
        triples_to = np.concatenate([[0], np.cumsum(triple)])
        stop = np.minimum(np.arange(len(keys)) + self.short, len(keys))
        near = np.flatnonzero(triples_to[stop] - triples_to[:-1] >= self.dense)
        # every place from which a window reaches a dense run
        edge = np.zeros(len(keys) + 1, np.int64)
        np.add.at(edge, np.maximum(near - self.reach, 0), 1)
        np.add.at(edge, np.minimum(near + self.short, len(keys)), -1)
        places = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (n, t, walks), member, holders in zip(self.tables, self.members, self.holders, strict=True):
            if n - 2 - 3 * t > 0:
                # only triples of items of this length count
                ours = member[which_triple]
                mine = hits[ours]
                if len(mine) < n - 2 - 3 * t:
                    continue
                begin = places
                fit = np.searchsorted(mine, np.minimum(begin + n + t, len(keys))) - np.searchsorted(mine, begin) >= n - 2 - 3 * t
                begin = begin[fit]
            else:
                begin = np.arange(len(keys))
            stop = np.minimum(begin + n + t, len(keys))
            fit = (words_to[stop] - words_to[begin] >= n - t) & (pairs_to[stop] - pairs_to[begin] >= n - 1 - 2 * t)
            begin = begin[fit]
            if not len(begin):
                continue
            begin = begin[offsets[row_of[begin] + 1] - begin >= n - t]
            if n >= self.sure and n - 2 - 3 * t > 0 and len(begin):
                # runs of windows, a row at a time
                cut = np.flatnonzero((np.diff(begin) > n + t) | (np.diff(row_of[begin]) > 0)) + 1
                for a, b in zip(begin[[0, *cut]].tolist(), begin[[*(cut - 1), -1]].tolist(), strict=True):
                    i, j = np.searchsorted(mine, [a, b + n + t])
                    for item in self._held(which_triple[ours][i:j], holders, n - 2 - 3 * t):
                        regions.setdefault((int(row_of[a]), item), []).append((a, b + n + t))
            for h, (hashes, which) in zip(embed(keys, begin, n, walks[0]), walks[1], strict=True):
                i, j = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                for k in np.flatnonzero(j > i):
                    row = int(row_of[begin[k]])
                    for item in which[i[k] : j[k]].tolist():
                        regions.setdefault((row, item), []).append((int(begin[k]) - t, int(begin[k]) + n + 2 * t))
        out = []
        for (row, item), spans in sorted(regions.items()):
            n = len(self.items[item])
            t = self.edits[n]
            best = (t + 1, -1)
            at, to = None, None
            for a, b in [*sorted(set(spans)), (1 << 62, 1 << 62)]:
                if at is not None and a > to:
                    a0, b0 = max(at, int(offsets[row])), min(to, int(offsets[row + 1]))
                    d, e = search(self.items[item], keys[a0:b0], t)
                    best = min(best, (d, a0 + e - int(offsets[row])))
                    at = None
                at, to = (a, b) if at is None else (at, max(to, b))
            if best[0] <= t:
                out.append((row, item, *best))
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", similarity: float = 0.8, repeats: int = 24, samples: int = 2, sure: int = 20, part_bytes: int = 32 << 20) -> DataFrame:
    """Per document: id, contaminated, n_items, and of the closest item best_item, best_edits and best_end (word)."""
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if parts > 1:
        rows = shared.numbered(rows, "row", "decontaminate-rows")

    def against(part: int, key: str) -> tuple[DataFrame, Broadcast]:
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        held = spark.sparkContext.broadcast(Finder([r.item for r in mine], [r.text for r in mine], similarity, repeats, samples, sure))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = held.value
            for batch in K.pieces(batches, "text", 8 << 20):
                found: dict[int, list] = {}
                for row, item, edits, end in finder.find(*plain_words(batch.column("text"))):
                    found.setdefault(row, []).append((edits, item, end))
                n, best, edits, ends = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
                for row, some in found.items():
                    n[row] = len(some)
                    edits[row], item, ends[row] = min(some)
                    best[row] = finder.ids[item]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n), pa.array(best, item_arrow), pa.array(edits, pa.int32()), pa.array(ends, pa.int64())], [key, "n_items", "best_item", "best_edits", "best_end"])

        made = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("n_items", T.IntegerType()), T.StructField("best_item", item_type), T.StructField("best_edits", T.IntegerType()), T.StructField("best_end", T.LongType())])
        return rows.select(key, "text").mapInArrow(work, made), held

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_type)
    if parts == 1:
        out = against(0, "id")[0]
    else:
        found = []
        for part in range(parts):
            some, held = against(part, "row")
            found.append(shared.keep(some.where("n_items > 0"), "decontaminate-part"))
            held.destroy()  # its part is written, so only one is in memory
        best = F.min(F.struct("best_edits", "best_item", "best_end")).alias("b")
        sums = reduce(DataFrame.union, found).groupBy("row").agg(F.sum("n_items").cast("int").alias("n_items"), best)
        out = rows.select("id", "row").join(sums, "row", "left").select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "b.best_item", "b.best_edits", "b.best_end")
    return out.withColumn("contaminated", F.col("n_items") > 0).withColumnRenamed("id", id_col)
