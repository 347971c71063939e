"""Katz backoff language model: Good-Turing discounted counts with exactly normalised, recursive backoff.

The model has order 2 or 3. P(w | h) of a history h of order - 1 words, h' being h without its first word:

* seen after h: d(c) * c(h, w) / c(h), with the order's own Good-Turing discount ratio d for c up to `k`;
* else alpha(h) * P(w | h'), alpha(h) = (mass left at h) / (1 - sum of P(. | h') over the words seen after h);
* a history that wasn't seen: P(w | h');
* P(w) = d(c) * c(w) / N for a known word; all unknown words are one class with the mass left over.

So P(. | h) sums to 1 over the known words and the unknown class for every h. A text is scored as its
words followed by one end token; the first word's history is a begin mark, which is not a token, and that
alone at any order.

How it runs. The scan is cut into blocks of documents (a partition's rows in order, up to
`block_tokens` words), each aggregated to its distinct keys before anything is shuffled:

1. blocks send distinct words with counts to word buckets (ranges of the word's hash), which number them,
   the frequent first, and write the unigram table: for each block the number and corpus count of each of its
   words, and counts of counts. Blocks are then written as sequences of numbers;
2. blocks send distinct bigrams to history buckets, which write the bigram table: corpus counts, and for each
   history its successors with counts 1..k and the sum of P over its successors, from which alpha follows
   exactly. Only blocks that back off from a history are told these two;
3. the same for trigrams, whose history is a bigram, with the bigram counts known by then;
4. blocks evaluate P recursively for each token.

What only one block holds is its own: a table tells a block which of its keys no other block asked for, and
n-grams after such a history are counted in the block and not sent.

A history with more than 1/(4 * buckets) of all training tokens (there are at most 4 * buckets such) is
spread over all buckets by its successor, and its partial sums are added up; so no bucket grows with a
frequent word. Bucket numbers grow with the input. A block sends a row to each bucket that it has a key for,
so rows grow faster than the input until each holds one key, but are never more than a shuffle by key would have.

Blocks are cut alike on each visit: a table that is no plain scan is written first, and the session's
files are split for the cores that it had at the start, whatever executors come and go. A text is never
cut, so one worker holds the longest text with its block.

Nulls: a null text is empty (one end token); a null id is kept. Repeated ids are separate documents.
With no training documents every token is unknown with probability 1 (score 0).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared

U64 = np.uint64
END = U64(0xE4D0E4D0E4D0E4D1)
#: The number of the begin mark, as a history; as a successor, the class of the words that were never seen there.
NONE = 0
LOW32 = U64((1 << 32) - 1)

_SENT = "bucket long, block long, payload binary"
_BACK = "kind string, bucket long, block long, n long, total long, payload binary"


def discounts(of_counts: np.ndarray, k: int) -> np.ndarray:
    """Good-Turing ratios d(1..k) from n_1..n_{k+1}, by Katz's formula.

    Where they aren't all in (0, 1], the cutoff is the largest below k for which they are, and greater counts
    keep their whole mass (1); where there is none, absolute ones (c - 1/2) / c.

    >>> [round(float(x), 3) for x in discounts(np.array([100, 40, 20, 12, 8, 6]), 5)]
    [0.688, 0.609, 0.687, 0.74, 0.844]
    >>> [round(float(x), 3) for x in discounts(np.array([100, 40, 20, 12, 8, 30]), 5)]
    [0.667, 0.583, 0.667, 0.722, 1.0]
    """
    c = np.arange(1, k + 1)
    n = of_counts.astype(float)
    for cut in range(k, 1, -1) if n[0] > 0 else ():
        with np.errstate(divide="ignore", invalid="ignore"):
            tail = (cut + 1) * n[cut] / n[0]
            d = ((c[:cut] + 1) * n[1 : cut + 1] / n[:cut] / c[:cut] - tail) / (1 - tail)
        if np.all(np.isfinite(d)) and np.all(d > 0) and np.all(d <= 1):
            return np.concatenate([d, np.ones(k - cut)])
    return (c - 0.5) / c


class Unigrams:
    """P(w) by a word's corpus count."""

    def __init__(self, n: int, v: int, of_counts: np.ndarray, k: int):
        self.n, self.v, self.k = n, v, k
        d = discounts(of_counts, k)
        left = float(np.sum((1 - d) * np.arange(1, k + 1) * of_counts[:k]))
        # with no count up to k nothing is discounted: the unknown class then takes one of n + 1 shares
        self.scale = 1.0 if left > 0 else n / (n + 1.0) if n else 0.0
        self.unknown = left / n if left > 0 else 1.0 / (n + 1.0)
        self.d = np.concatenate([[0.0], d])

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        ratio = np.where(c <= self.k, self.d[np.minimum(c, self.k)], 1.0)
        return np.where(c > 0, ratio * c / max(self.n, 1) * self.scale, self.unknown)


def alpha_of(total: np.ndarray, small: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of the seen, alpha) by history, from c(h), the successors with counts 1..k (columns) and sum P."""
    total = total.astype(float)
    left = (small * ((1 - d) * np.arange(1, len(d) + 1))).sum(axis=1)
    some = left > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = np.where(some, left / total, 1 / (total + 1))
        alpha = np.where(total > 0, mass / np.maximum(1 - lower, 1e-300), 1.0)
    return np.where(some, 1.0, total / (total + 1)), alpha


def _blocks(tokens: int) -> Callable:
    """Cuts a partition's batches into blocks; numbers depend on the partition and the row order alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 24, 0
        held, size = [], 0
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.diff(K.buffers(batch.column("text"))[1]))
            while at < batch.num_rows:
                room = tokens * 6 - size + (sizes[at - 1] if at else 0)
                to = max(at + (not held), int(np.searchsorted(sizes, room, "right")))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
                    at = to
                if at < batch.num_rows:
                    yield base | seq, pa.Table.from_batches(held)
                    seq, held, size = seq + 1, [], 0
        if held:
            yield base | seq, pa.Table.from_batches(held)

    return cut


def _sequence(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word keys with an END after each text, and the texts' offsets."""
    parts, lengths = [], []
    for chunk in text.chunks:
        keys, offsets = K.words(chunk)
        parts.append(np.insert(keys, offsets[1:], END))
        lengths.append(np.diff(offsets) + 1)
    n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(n)])


def _slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of a sorted key array starts (buckets + 1)."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64) if buckets > 1 else np.zeros(0, U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


_SENT_A = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])
_BACK_A = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("payload", pa.binary())])


class _Grams:
    """The distinct n-grams of a block, by history and word, and what is known of their histories.

    `history` is each token's history, a place in `first` and `last` (its two numbers, in their order), -1
    where it was never seen; `below` is the count of the token's n-gram without its first word.
    """

    def __init__(self, history: np.ndarray, words: np.ndarray, train: np.ndarray, first: np.ndarray, last: np.ndarray, total: np.ndarray, own: np.ndarray, below: np.ndarray, buckets: int, hot: np.ndarray):
        self.history, self.first, self.last, self.total, self.own = history, first, last, total, own
        tokens = np.flatnonzero(history >= 0)
        key = history[tokens].astype(U64) << U64(32) | np.where(below[tokens] > 0, words[tokens], NONE).astype(U64)
        key, example, which = np.unique(key, return_index=True, return_inverse=True)
        self.which = np.full(len(history), -1, np.int64)
        self.which[tokens] = which
        self.example = tokens[example]
        self.h, self.w = (key >> U64(32)).astype(np.int64), key & LOW32
        self.count = np.bincount(which, train[tokens], len(key)).astype(np.int64)
        self.below = below[self.example]
        # what follows a history that other blocks know too is sent; a hot history is spread by its successor, any other goes by itself
        self.sent = np.flatnonzero(~own[self.h])
        at = self.h[self.sent]
        name = first[at].astype(U64) << U64(32) | last[at].astype(U64)
        route = K.mix(name ^ U64(0x5851F42D4C957F2D))
        if len(hot):
            route = np.where(hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name, K.fold(name, self.w[self.sent]), route)
        bucket = ((route >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        self.sent = self.sent[order]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def unsent(self, k: int) -> np.ndarray:
        """Counts of counts 1..k+1 of the n-grams that aren't sent."""
        return np.bincount(np.minimum(self.count[self.own[self.h]], k + 2), minlength=k + 3)[1 : k + 2]

    def rows(self, block: int, below_history: np.ndarray, k: int) -> list[tuple]:
        """A row for each bucket that gets something; the first has the counts of counts of what isn't sent."""
        out, unsent = [], self.unsent(k)
        for b in range(len(self.cuts) - 1):
            mine = self.sent[self.cuts[b] : self.cuts[b + 1]]
            if len(mine) or (b == len(self.cuts) - 2 and not out):
                starts = K.segments(self.h[mine])
                at = self.h[mine][starts]
                lengths = np.diff(starts, append=len(mine))
                parts = [K.pack(unsent * (not out)), K.pack_sorted(self.first[at]), K.pack(self.last[at]), K.pack(below_history[at]), K.pack(lengths), K.pack(self.w[mine]), K.pack(self.count[mine]), K.pack(self.below[mine])]
                out.append((b, block, b"".join(parts)))
        return out


def _sums(h: np.ndarray, total: np.ndarray, p: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By history: the successors with counts 1..k (columns), and the sum of the lower order's p over those seen."""
    small = np.stack([np.bincount(h[total == i], minlength=m) for i in range(1, k + 1)], axis=1).astype(np.int64)
    seen = total > 0
    return small, np.bincount(h[seen], p[seen], m).astype(float)  # of nothing, integers


def _bits(small: np.ndarray) -> np.ndarray:
    """Which of the counts 1..k occur, as bits."""
    return ((small > 0) << np.arange(small.shape[1])).sum(axis=1)


def _leaves(bits: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether discounting leaves any mass, from those bits."""
    return bits & int(((d < 1) << np.arange(len(d))).sum()) > 0


def _seen(count: np.ndarray, total: np.ndarray, leaves: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P of an n-gram that was seen."""
    ratio = np.where(count <= len(d), np.concatenate([[0.0], d])[np.minimum(count, len(d))], 1.0)
    return np.where(leaves, 1.0, total / (total + 1.0)) * ratio * count / np.maximum(total, 1)


class _Block:
    """A block as numbers of words, and its levels as far as their tables are given."""

    def __init__(self, group: pa.Table, begun: int):
        self.kinds, self.at = np.array(group["kind"].to_pylist()), np.array(group["bucket"].to_pylist())
        self.group = group
        row = int(np.flatnonzero(self.kinds == "seq")[0])
        data = group["payload"][row].as_py()
        self.ids = group["ids"][row].values
        names, pos = K.unpack_sorted(data)
        told, pos = K.unpack(data, pos)
        seq, pos = K.unpack(data, pos)
        lengths, pos = K.unpack(data, pos)
        flags, pos = K.unpack(data, pos)
        self.flags, self.n = flags.astype(bool), lengths.astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.n)])
        seq = seq.astype(np.int64)
        self.words, self.train = names.astype(np.int64)[seq], np.repeat(self.flags, self.n)
        count, own = (told >> U64(1)).astype(np.int64), (told & U64(1)).astype(bool)
        self.count = count[seq]
        self.begins = np.zeros(len(seq), bool)
        self.begins[self.offsets[:-1]] = True
        # histories of one word: the begin mark, then the block's words
        self.names, self.totals, self.owned = np.concatenate([[NONE], names.astype(np.int64)]), np.concatenate([[begun], count]), np.concatenate([[False], own])
        history = np.zeros(len(seq), np.int64)
        history[1:] = seq[:-1] + 1
        history[self.begins] = 0
        self.history = np.where(self.totals[history] > 0, history, -1)

    def pairs(self, buckets: int, hot: np.ndarray) -> _Grams:
        return _Grams(self.history, self.words, self.train, np.zeros_like(self.names), self.names, self.totals, self.owned, self.count, buckets, hot)

    def triples(self, pairs: _Grams, counts: np.ndarray, own: np.ndarray, buckets: int, hot: np.ndarray) -> _Grams:
        """From the bigrams' corpus counts, and whether they are this block's own."""
        history = np.full(len(self.words), -1, np.int64)
        history[1:] = pairs.which[:-1]
        history[self.begins] = -1
        history[(history >= 0) & (counts[history] == 0)] = -1
        below = np.where(pairs.which >= 0, counts[pairs.which], 0)
        return _Grams(history, self.words, self.train, pairs.last[pairs.h], pairs.w.astype(np.int64), counts, own, below, buckets, hot)

    def told(self, grams: _Grams, kind: str, lower: np.ndarray, d: np.ndarray, hot: tuple, k: int) -> tuple[np.ndarray, ...]:
        """(corpus counts of the n-grams, whether own, whether histories leave mass, each token's P) from `lower`, P one order below."""
        m = len(grams.total)
        counts, own = grams.count.copy(), np.ones(len(grams.h), bool)
        kept = grams.own[grams.h]
        small, sums = _sums(grams.h[kept], counts[kept], lower[grams.example[kept]], m, k)
        bits = _bits(small)
        got = 0
        for i in np.flatnonzero(self.kinds == kind):
            mine = grams.sent[grams.cuts[self.at[i]] : grams.cuts[self.at[i] + 1]]
            if not len(mine):
                continue
            got += len(mine)
            data = self.group["payload"][int(i)].as_py()
            told, pos = K.unpack(data)
            assert len(told) == len(mine), "a block changed between two visits"
            counts[mine], own[mine] = (told >> U64(1)).astype(np.int64), (told & U64(1)).astype(bool)
            starts = K.segments(grams.h[mine])
            at = grams.h[mine][starts]
            some, pos = K.unpack(data, pos)
            bits[at] = some.astype(np.int64)
            off = at[np.logical_or.reduceat(counts[mine] == 0, starts)]
            few, pos = K.unpack(data, pos)
            small[off] = few.astype(np.int64).reshape(-1, k)
            sums[off] = np.frombuffer(data, float, len(off), pos)
        assert got == len(grams.sent), "a block changed between two visits"
        hot_name, hot_small, hot_sums = hot
        if len(hot_name):
            name = grams.first.astype(U64) << U64(32) | grams.last.astype(U64)
            spot = np.minimum(np.searchsorted(hot_name, name), len(hot_name) - 1)
            mine = np.flatnonzero((hot_name[spot] == name) & ~grams.own)
            small[mine], sums[mine] = hot_small[spot[mine]], hot_sums[spot[mine]]
            bits[mine] = _bits(small[mine])
        leaves = _leaves(bits, d)
        _, alpha = alpha_of(grams.total, small, sums, d)
        known = np.flatnonzero(grams.which >= 0)
        which, h = grams.which[known], grams.history[known]
        p = lower.copy()
        p[known] = np.where(counts[which] > 0, _seen(counts[which], grams.total[h], leaves[h], d), alpha[h] * lower[known])
        return counts, own, leaves, p


def katz_scores(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, k: int = 5, block_tokens: int = 800_000, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Scores every text of docs with a model, of order 2 or 3, of the texts where `train` holds.

    Returns id, held_out, n_tokens, n_known, train_tokens (N), vocabulary (V), base_score (add-one
    unigram) and score, both as log10 of the text's probability.
    """
    if order not in (2, 3):
        raise ValueError(f"order is {order}, not 2 or 3")
    spark = docs.sparkSession
    # the blocks must be the same rows on each visit, so anything but a plain scan is written first
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    if not shared.plain_scan(docs):
        docs = shared.keep(docs, "katz-docs")
    shared.same_splits(spark)
    buckets = shared.buckets(docs, bucket_bytes)
    cut = _blocks(block_tokens)

    def count_words(batches):
        for block, table in cut(batches):
            seq, offsets = _sequence(table["text"])
            train = np.repeat(table["train"].to_numpy(), np.diff(offsets))
            keys, where = np.unique(seq, return_inverse=True)
            counts = np.bincount(where[train], minlength=len(keys))
            cuts = _slices(keys, buckets)
            yield _rows(_SENT_A, [(b, block, K.pack_sorted(keys[i:j]) + K.pack(counts[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i])
            del seq, train, keys, where, counts
            K.trim()

    hot_share = 1.0 / (4 * buckets)

    def add_words(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        blocks, keys, counts = group["block"].to_pylist(), [], []
        for data in group["payload"]:
            data = data.as_py()
            a, at = K.unpack_sorted(data)
            keys.append(a)
            counts.append(K.unpack(data, at)[0].astype(np.int64))
        every, where, asked = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        total = np.bincount(where, np.concatenate(counts), len(every)).astype(np.int64)
        # a word's number: its rank here, then the bucket, so that frequent words have small ones
        name = np.empty(len(every), np.int64)
        name[np.argsort(-total, kind="stable")] = np.arange(len(every)) * buckets + bucket + 1
        if name.max() >> 32:
            raise ValueError("more than 2^32 distinct words")
        told = total * 2 + (asked == 1)
        ends = np.cumsum([len(x) for x in keys])
        rows = [("back", bucket, block, 0, 0, K.pack(told[where[e - len(x) : e]]) + K.pack(name[where[e - len(x) : e]])) for block, x, e in zip(blocks, keys, ends, strict=True)]
        small = np.bincount(np.minimum(total, k + 2), minlength=k + 3)[1 : k + 2]
        rows += [("of_counts", bucket, i + 1, int(n), 0, b"") for i, n in enumerate(small)]
        rows.append(("size", bucket, 0, int((total > 0).sum()), int(total.sum()), b""))
        # candidates for hot histories: those with that share of the bucket's own tokens are a superset within it
        often = np.flatnonzero(total >= max(1, hot_share * total.sum()))
        rows += [("often", bucket, -1, int(total[i]), int(name[i]), b"") for i in often]
        return pa.Table.from_batches([_rows(_BACK_A, rows)])

    words = shared.keep(docs.mapInArrow(count_words, _SENT).groupBy("bucket").applyInArrow(add_words, _BACK), "katz-words")
    facts = {(r.kind, r.at): (r.n, r.total) for r in words.where("kind in ('of_counts', 'size')").groupBy("kind", F.col("block").alias("at")).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    v, n_train = facts.get(("size", 0), (0, 0))
    uni = Unigrams(n_train, v, np.array([facts.get(("of_counts", i), (0, 0))[0] for i in range(1, k + 2)]), k)
    begun = docs.where("train").count()

    def often(table: DataFrame) -> list[int]:
        # at most 4 * buckets histories have this share of all tokens
        return [r.total for r in table.where((F.col("kind") == "often") & (F.col("n") >= max(1, hot_share * n_train))).select("total").collect()]

    def send_blocks(batches):
        for block, table in cut(batches):
            text, ids = table["text"].combine_chunks(), table["id"]
            data, offsets = K.buffers(text)
            payload = K.pack(np.diff(offsets)) + K.pack(table["train"].to_numpy().astype(U64)) + np.uint64(len(data)).tobytes() + pa.compress(data, "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array(["text"]), pa.array([-1], pa.int64()), pa.array([payload], pa.binary()), pa.array([ids.to_pylist()], pa.list_(ids.type))], ["block", "kind", "bucket", "payload", "ids"])

    id_type = docs.schema["id"].dataType
    block_type = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type))])

    def met(blocks: DataFrame, *tables: tuple[str, DataFrame]):
        out = blocks
        for kind, table in tables:
            out = out.unionByName(table.where("kind = 'back'").select("block", F.lit(kind).alias("kind"), "bucket", "payload"), allowMissingColumns=True)
        return out.groupBy("block")

    def number(group: pa.Table) -> pa.Table:
        """A block's texts as numbers of words, with the words' corpus counts."""
        kinds, at = np.array(group["kind"].to_pylist()), np.array(group["bucket"].to_pylist())
        row = int(np.flatnonzero(kinds == "text")[0])
        data = group["payload"][row].as_py()
        lengths, pos = K.unpack(data)
        flags, pos = K.unpack(data, pos)
        size = int(np.frombuffer(data, U64, 1, pos)[0])
        raw = pa.decompress(memoryview(data)[pos + 8 :], size, "zstd") if size else pa.py_buffer(b"")
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), raw])
        seq, offsets = _sequence(pa.chunked_array([column]))
        del raw, column
        keys, where = np.unique(seq, return_inverse=True)
        mine = np.flatnonzero(kinds == "words")
        told, names = [], []
        for i in mine[np.argsort(at[mine])]:
            data = group["payload"][int(i)].as_py()
            a, pos = K.unpack(data)
            told.append(a)
            names.append(K.unpack(data, pos)[0])
        told, names = np.concatenate(told), np.concatenate(names)
        assert len(told) == len(keys), "a block changed between two visits"
        by = np.argsort(names)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        payload = K.pack_sorted(names[by]) + K.pack(told[by]) + K.pack(place[where]) + K.pack(np.diff(offsets)) + K.pack(flags)
        ids = group["ids"].combine_chunks().slice(row, 1) if group["ids"].num_chunks else group["ids"]
        del seq, keys, where, told, names
        K.trim()
        return pa.table([pa.array([group["block"][0].as_py()]), pa.array(["seq"]), pa.array([-1], pa.int64()), pa.array([payload], pa.binary()), ids], ["block", "kind", "bucket", "payload", "ids"])

    seqs = shared.keep(met(docs.mapInArrow(send_blocks, block_type), ("words", words)).applyInArrow(number, block_type), "katz-blocks")

    def adds(lower: Callable) -> Callable:
        """Adds up a bucket's n-grams; `lower` gives P one order below of those seen, from (their count there, what was sent with the history)."""
        hot = hots[-1]

        def add(group: pa.Table) -> pa.Table:
            bucket, blocks, unsent, parts = group["bucket"][0].as_py(), group["block"].to_pylist(), np.zeros(k + 1, np.int64), []
            for data in group["payload"]:
                data = data.as_py()
                a, at = K.unpack(data)
                unsent += a.astype(np.int64)
                first, at = K.unpack_sorted(data, at)
                arrays = [first]
                for _ in range(6):
                    a, at = K.unpack(data, at)
                    arrays.append(a)
                parts.append(arrays)
            first, last, below_h, lengths, w, count, below = (np.concatenate(x) for x in zip(*parts, strict=True))
            per_h, per_w = np.cumsum([0] + [len(x[0]) for x in parts]), np.cumsum([0] + [len(x[4]) for x in parts])
            del parts
            names, example_h, where_h = np.unique(first << U64(32) | last, return_index=True, return_inverse=True)
            del first, last
            key, example, which, asked = np.unique(np.repeat(where_h, lengths.astype(np.int64)).astype(U64) << U64(32) | w, return_index=True, return_inverse=True, return_counts=True)
            h, w, m = (key >> U64(32)).astype(np.int64), key & LOW32, len(names)
            total = np.bincount(which, count, len(key)).astype(np.int64)
            small, sums = _sums(h, total, lower(below[example].astype(np.int64), below_h[example_h][h].astype(np.int64)), m, k)
            bits, told = _bits(small), total * 2 + (asked == 1)
            del count, below, below_h, key, example, asked
            K.trim()
            rows = []
            for j, block in enumerate(blocks):
                at, mine = where_h[per_h[j] : per_h[j + 1]], which[per_w[j] : per_w[j + 1]]
                if not len(mine):
                    continue
                starts = np.concatenate([[0], np.cumsum(lengths[per_h[j] : per_h[j + 1]].astype(np.int64))[:-1]])
                off = at[np.logical_or.reduceat(total[mine] == 0, starts)]
                rows.append(("back", bucket, block, 0, 0, K.pack(told[mine]) + K.pack(bits[at]) + K.pack(small[off].ravel()) + sums[off].tobytes()))
            rows += [("of_counts", bucket, i, int((total == i).sum() + unsent[i - 1]), 0, b"") for i in range(1, k + 2)]
            for i in np.flatnonzero(total >= max(1, hot_share * n_train)):
                if not names[h[i]] >> U64(32):  # as a history of the next order
                    rows.append(("often", bucket, -1, int(total[i]), int((names[h[i]] << U64(32) | w[i]).view(np.int64)), b""))
            for i in np.flatnonzero(np.isin(names, hot)):
                rows.append(("hot", bucket, -1, 0, 0, np.concatenate([names[i : i + 1], small[i].astype(U64), sums[i : i + 1].view(U64)]).astype(U64).tobytes()))
            return pa.Table.from_batches([_rows(_BACK_A, rows)])

        return add

    def open_hot(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(x.as_py() for x in batch.column("payload")), U64).reshape(-1, k + 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(raw[:, i].view(np.int64)) for i in range(k + 1)), pa.array(np.ascontiguousarray(raw[:, k + 1]).view(np.float64))], ["h", *(f"s{i}" for i in range(k)), "lower"])

    def table_of(sent: DataFrame, lower: Callable, name: str) -> tuple[DataFrame, np.ndarray, tuple]:
        """The written table of an order, its discounts, and its hot histories' sums."""
        table = shared.keep(sent.groupBy("bucket").applyInArrow(adds(lower), _BACK), name)
        of = {r.block: r.n for r in table.where("kind = 'of_counts'").groupBy("block").agg(F.sum("n").alias("n")).collect()}
        d = discounts(np.array([of.get(i, 0) for i in range(1, k + 2)]), k)
        # the hot histories' partial sums; at most 4 * buckets histories, added up by the executors before they are read
        opened = table.where("kind = 'hot'").select("payload").mapInArrow(open_hot, "h long, " + ", ".join(f"s{i} long" for i in range(k)) + ", lower double")
        found = opened.groupBy("h").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)), F.sum("lower").alias("lower")).collect() if len(hots[-1]) else []
        names = np.array([r.h for r in found], np.int64).view(U64)
        by = np.argsort(names)
        return table, d, (names[by], np.array([[r[f"s{i}"] for i in range(k)] for r in found], np.int64).reshape(-1, k)[by], np.array([r.lower for r in found], float)[by])

    hots = [np.unique(np.array(often(words) + [NONE] * (begun >= hot_share * max(n_train, 1)), np.int64).view(U64))]

    def send_pairs(batches):
        hot = hots[0]
        for batch in batches:
            for i in range(batch.num_rows):
                group = pa.Table.from_batches([batch.slice(i, 1)])
                x = _Block(group, begun)
                pairs = x.pairs(buckets, hot)
                yield _rows(_SENT_A, pairs.rows(group["block"][0].as_py(), np.zeros(len(pairs.total), np.int64), k))
                del x, pairs, group
                K.trim()

    pairs, d2, hot2 = table_of(seqs.mapInArrow(send_pairs, _SENT), lambda below, _: uni.p(below), "katz-pairs")
    tables = [("pairs", pairs)]
    if order == 3:
        hots.append(np.unique(np.array(often(pairs), np.int64).view(U64)))
        hot_pairs, hot_triples = hots

        def send_triples(group: pa.Table) -> pa.Table:
            x = _Block(group, begun)
            two = x.pairs(buckets, hot_pairs)
            counts, own, leaves, _ = x.told(two, "pairs", uni.p(x.count), d2, hot2, k)
            three = x.triples(two, counts, own, buckets, hot_triples)
            # with a history goes what the order below needs: the count of its last word as a history, and whether that leaves mass
            last = x.history[three.example]
            below = np.zeros(len(three.total), np.int64)
            below[three.h] = x.totals[last] * 2 + leaves[last]
            rows = three.rows(group["block"][0].as_py(), below, k)
            del x, two, three, counts, own, leaves, last, below
            K.trim()
            return pa.Table.from_batches([_rows(_SENT_A, rows)])

        triples, d3, hot3 = table_of(met(seqs, ("pairs", pairs)).applyInArrow(send_triples, _SENT), lambda below, h: _seen(below, h >> 1, (h & 1).astype(bool), d2), "katz-triples")
        tables.append(("triples", triples))

    hot_pairs, hot_triples = hots[0], hots[-1]

    def evaluate(group: pa.Table) -> pa.Table:
        x = _Block(group, begun)
        grams = x.pairs(buckets, hot_pairs)
        counts, own, _, p = x.told(grams, "pairs", uni.p(x.count), d2, hot2, k)
        if order == 3:
            grams = x.triples(grams, counts, own, buckets, hot_triples)
            *_, p = x.told(grams, "triples", p, d3, hot3, k)
        del grams, counts, own
        at0, ids, n, held = x.offsets[:-1], x.ids, x.n, ~x.flags
        base = np.add.reduceat(np.log10((x.count + 1.0) / (n_train + (v + 1.0))), at0)
        score = np.add.reduceat(np.log10(np.maximum(p, 5e-324)), at0)
        known = np.add.reduceat((x.count > 0).astype(np.int64), at0)
        del x, p
        K.trim()
        return pa.table({"id": ids, "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), n_train), "vocabulary": np.full(len(n), v), "base_score": base, "score": score})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("vocabulary", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return met(seqs, *tables).applyInArrow(evaluate, schema).withColumnRenamed("id", id_col)
