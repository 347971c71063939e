"""Token counts of a SentencePiece BPE model by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbols. In a round every sequence finds its lowest-rank
adjacent pair, the leftmost of equals, all sequences merge theirs at once, and sequences without a pair
leave; what survives is counted. A long sequence is laid out in segments that know their lowest rank, and
merges all places of a round's pair up to the first whose new neighbours rank lower (ranks don't always
grow with merges here). Characters without a piece count as their UTF-8 bytes.

The model must have an identity normaliser, a dummy prefix, no piece with a word mark after another
character, and runs of marks that merge last; ``PieceModel.load`` checks this. Then pre-tokens are
independent: a text is cut at blanks and at control characters that no piece holds, each distinct
pre-token is merged once, and runs of word marks are merged by their lengths alone. Pre-tokens are told
apart by a 63-bit hash: among the 600,000 that a process remembers two share one with a chance of 2e-8.

Null and empty texts have no tokens. Texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K

U64 = np.uint64
MARK = "▁"
NONE = np.int32(2**31 - 1)
LONG = 400  # symbols beyond which a sequence is laid out in segments
SEGMENT = 256

REMEMBERED = 600_000  # words whose counts a process keeps


@dataclass
class PieceModel:
    points: np.ndarray  # code points that are pieces, and their ids
    point_ids: np.ndarray
    pairs: np.ndarray  # left << 15 | right, sorted as they come
    merged: np.ndarray  # the pair's piece
    rank: np.ndarray  # by piece
    mark: int
    runs: frozenset  # lengths of the pieces that hold marks alone
    breaks: tuple  # control characters that no piece holds

    @staticmethod
    def load(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with byte fallback, an identity normaliser and a dummy prefix is needed")
        if len(proto.pieces) > 1 << 15:
            raise ValueError("at most 32768 pieces")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        runs = {len(p) for p in normal if set(p) == {MARK}}
        if any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and set(p) != {MARK}) or " " in p for p in normal):
            raise ValueError("a piece crosses a pre-token")
        scores = {p: proto.pieces[i].score for p, i in normal.items()}
        if len({scores[MARK * n] for n in runs if n > 1}) > 1 or any(s <= scores[MARK * n] for n in runs if n > 1 for p, s in scores.items() if len(p) > 1 and set(p) != {MARK}):
            raise ValueError("runs of marks are not the last to merge")
        breaks = tuple(i for i in range(9, 14) if not any(chr(i) in p for p in normal))
        order = sorted((p for p in normal if set(p) != {MARK} or len(p) == 1), key=lambda p: -proto.pieces[normal[p]].score)
        rank = np.full(len(proto.pieces), NONE, np.int32)
        for r, p in enumerate(p for p in order if len(p) > 1):
            rank[normal[p]] = r
        pairs, merged = [], []
        for p in order:
            for k in range(1, len(p)):
                if p[:k] in normal and p[k:] in normal:
                    pairs.append(normal[p[:k]] << 15 | normal[p[k:]])
                    merged.append(normal[p])
        single = [p for p in normal if len(p) == 1]
        return PieceModel(np.array([ord(p) for p in single]), np.array([normal[p] for p in single], np.int32), np.array(pairs, np.uint32), np.array(merged, np.int32), rank, normal[MARK], frozenset(runs), breaks)


class Merger:
    """A model's lookup tables, built in the process that uses them."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.of_point = np.full(0x110000, -1, np.int32)
        self.of_point[model.points] = model.point_ids
        self.bits = max(10, int(len(model.pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, 0xFFFFFFFF, np.uint32)
        self.values = np.full(size, -1, np.int32)
        slot, todo = self._slot(model.pairs), np.arange(len(model.pairs))
        while len(todo):  # open addressing, all keys at once
            free = self.keys[slot[todo]] == 0xFFFFFFFF
            first = np.unique(slot[todo[free]], return_index=True)[1]
            won = todo[free][first]
            self.keys[slot[won]] = model.pairs[won]
            self.values[slot[won]] = model.merged[won]
            left = np.ones(len(model.pairs), bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) % size
        self.word = np.ones(256, bool)
        self.word[[32, *model.breaks]] = False
        self.seen = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.of_run: dict[int, int] = {0: 0}
        self.rank = np.append(model.rank, NONE)  # -1 gives NONE

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = (left.astype(np.uint32) << np.uint32(15)) | right.astype(np.uint32)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        out[(left < 0) | (right < 0)] = -1
        todo = np.flatnonzero((found != keys) & (found != 0xFFFFFFFF) & (left >= 0) & (right >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.keys)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != 0xFFFFFFFF)]
        return out

    def runs(self, n: np.ndarray) -> np.ndarray:
        """Tokens of runs of n marks: all pairs rank alike, so the leftmost pair goes first."""
        every, where = np.unique(n, return_inverse=True)
        for x in every.tolist():
            if x not in self.of_run:
                done: list[int] = []
                for _ in range(x):  # done holds what no longer merges by itself
                    done.append(1)
                    while len(done) > 1 and done[-2] + done[-1] in self.model.runs:
                        done[-2:] = [done[-2] + done[-1]]
                self.of_run[x] = len(done)
        return np.array([self.of_run[x] for x in every.tolist()], np.int64)[where] if len(n) else np.zeros(0, np.int64)

    def _segmented(self, symbols: np.ndarray) -> np.ndarray:
        """The surviving symbols of a long sequence."""
        n = len(symbols)
        blocks = -(-n // SEGMENT)
        sym = np.append(symbols, np.int32(-1)).astype(np.int32)  # place n ends the sequence, and stands before it too
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        before[0] = n
        piece = np.full(blocks * SEGMENT, -1, np.int32)
        piece[: n - 1] = self.pair(sym[: n - 1], sym[1:n])
        rank = self.rank[piece]
        grid = rank.reshape(blocks, SEGMENT)
        lowest = grid.min(axis=1)
        gone = np.zeros(n + 1, bool)
        while (low := lowest.min()) != NONE:
            where = np.flatnonzero(lowest == low)
            block, place = np.nonzero(grid[where] == low)
            at = where[block] * SEGMENT + place
            # of places that overlap, every other one
            joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[turn % 2 == 0]
            made, nxt = piece[at], after[after[at]]
            # the neighbours as they are when a place's turn comes: merged on its left, not yet on its right
            left = before[at]
            left_sym = sym[left]
            close = np.concatenate([[False], nxt[:-1] == at[1:]])
            left_sym[close] = made[np.flatnonzero(close) - 1]
            worse = (self.rank[self.pair(left_sym, made)] < low) | (self.rank[self.pair(made, sym[nxt])] < low)
            if worse.any():
                last = int(np.argmax(worse)) + 1
                at, made, nxt = at[:last], made[:last], nxt[:last]
            dead = after[at]
            gone[dead] = True
            sym[at], after[at] = made, nxt
            before[nxt[nxt < n]] = at[nxt < n]
            rank[dead], piece[dead] = NONE, -1
            changed = np.unique(np.concatenate([at, before[at][before[at] < n]]))
            piece[changed] = self.pair(sym[changed], sym[after[changed]])
            rank[changed] = self.rank[piece[changed]]
            where = np.unique(np.concatenate([changed, dead]) // SEGMENT)
            lowest[where] = grid[where].min(axis=1)
        return sym[:n][~gone[:n]]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(surviving symbols other than -1, first surviving symbol) of each sequence; all have a symbol."""
        count, first = np.zeros(len(lengths), np.int64), np.full(len(lengths), -1, np.int32)
        starts = np.cumsum(lengths) - lengths
        for s in np.flatnonzero(lengths > LONG):
            left = self._segmented(symbols[starts[s] : starts[s] + lengths[s]])
            count[s], first[s] = np.count_nonzero(left >= 0), left[0]
        active = np.flatnonzero(lengths <= LONG)
        sym = symbols[K.ranges(starts[active], lengths[active])]
        n = lengths[active].copy()
        at = np.cumsum(n) - n

        def pieces(i: np.ndarray, ends: np.ndarray) -> np.ndarray:
            out = np.full(len(i), -1, np.int32)
            ok = ~ends[i]
            out[ok] = self.pair(sym[i[ok]], sym[i[ok] + 1])
            return out

        ends = np.zeros(len(sym), bool)
        ends[at + n - 1] = True
        piece = pieces(np.arange(len(sym)), ends)
        while len(active):
            rank = self.rank[piece]
            low = np.minimum.reduceat(rank, at)
            done = low == NONE
            if done.any():
                known = np.add.reduceat((sym >= 0).astype(np.int64), at)
                count[active[done]], first[active[done]] = known[done], sym[at[done]]
                stay = ~done
                keep = np.repeat(stay, n)
                sym, piece, rank, ends = sym[keep], piece[keep], rank[keep], ends[keep]
                active, n, low = active[stay], n[stay], low[stay]
                at = np.cumsum(n) - n
                if not len(active):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, n))
            owner = np.searchsorted(at, hit, "right")
            hit = hit[np.concatenate([[True], owner[1:] != owner[:-1]])]
            sym[hit] = piece[hit]
            ends[hit] = ends[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep) - 1
            sym, piece, ends = sym[keep], piece[keep], ends[keep]
            n = n - 1
            at = np.cumsum(n) - n
            here = new[hit]
            touched = np.zeros(len(sym), bool)
            touched[here] = True
            touched[here[here > 0] - 1] = True
            changed = np.flatnonzero(touched)
            piece[changed] = pieces(changed, ends)
        return count, first

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each row."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # the normaliser makes them one
        data, offsets = K.buffers(column)
        rows = len(offsets) - 1
        total = np.zeros(rows, np.int64)
        found = [self._add(data, offsets, at, to, total) for at, to in K.cuts(data, offsets, self.word)]
        if found:
            keys, first, last, before = (np.concatenate(x) for x in zip(*found, strict=True))
            every, example, where = np.unique(keys, return_index=True, return_inverse=True)
            tokens, lone = self._known(every, data, first[example], last[example], before[example] > 0)
            # a run's last mark goes with its word, unless it stays alone
            extra = np.where(before == 0, 0, np.where(lone[where], self.runs(before) - 1, self.runs(np.maximum(before - 1, 0))))
            total += np.bincount(np.searchsorted(offsets, first, "right") - 1, tokens[where] + extra, rows).astype(np.int64)
        return total

    def _known(self, keys: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, whether the mark stays alone) by sorted key; words of earlier calls are remembered, up to a bound."""
        at = np.minimum(np.searchsorted(self.seen[0], keys), max(len(self.seen[0]) - 1, 0))
        old = self.seen[0][at] == keys if len(self.seen[0]) else np.zeros(len(keys), bool)
        tokens, lone = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        tokens[old], lone[old] = self.seen[1][at[old]], self.seen[2][at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            n = (last - first)[new]
            ends = np.cumsum(n)
            tokens[new], lone[new] = self._words(data[K.ranges(first[new], n)], ends - n, ends, marked[new])
            if len(self.seen[0]) + len(new) > REMEMBERED:
                self.seen = (keys, tokens, lone)
            else:
                order = np.argsort(every := np.concatenate([self.seen[0], keys[new]]), kind="stable")
                self.seen = (every[order], np.concatenate([self.seen[1], tokens[new]])[order], np.concatenate([self.seen[2], lone[new]])[order])
        return tokens, lone

    def _add(self, data: np.ndarray, offsets: np.ndarray, at: int, to: int, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts what is no word into total; (key, start, end, marks before) of the words of data[at:to]."""
        part = data[at:to]
        first, last = K.spans(data, offsets, at, to, self.word)

        def row_of(i: np.ndarray) -> np.ndarray:
            return np.searchsorted(offsets, i + at, "right") - 1

        # control characters between words are single bytes; a row's dummy mark joins the blanks at its start
        control = ~self.word[part] & (part != 32)
        total += np.bincount(row_of(np.flatnonzero(control)), minlength=len(total))
        begins = offsets[:-1][(offsets[:-1] >= at) & (offsets[:-1] < to) & (np.diff(offsets) > 0)] - at
        is_begin = np.zeros(len(part) + 1, bool)
        is_begin[begins] = True
        blank = part == 32
        # runs of blanks: maximal within a row
        run = np.flatnonzero(blank & (~np.concatenate([[False], blank[:-1]]) | is_begin[:-1]))
        stop = np.flatnonzero(blank & (~np.concatenate([blank[1:], [False]]) | is_begin[1:])) + 1
        marks = stop - run + is_begin[run]
        after_run = np.zeros(len(part) + 1, np.int64)
        closes = ~is_begin[stop]  # what follows is of the same row
        after_run[stop[closes]] = marks[closes]
        # a run that ends a row, or stands before a control character, counts by itself
        starts_word = np.zeros(len(part) + 1, bool)
        starts_word[first] = True
        alone = ~closes | ~starts_word[stop]
        total += np.bincount(row_of(run[alone]), self.runs(marks[alone]), len(total)).astype(np.int64)
        lonely = begins[~blank[begins] & ~starts_word[begins]]  # a dummy mark before a control character
        total += np.bincount(row_of(lonely), minlength=len(total))
        before = np.where(is_begin[first], 1, after_run[first])
        power, inverse = K.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=sums[1:])
        keys = K.mix((sums[last] - sums[first]) * inverse[first])
        return (keys & ~U64(1)) | (before > 0).astype(U64), first + at, last + at, before

    def _words(self, part: np.ndarray, first: np.ndarray, last: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, whether the mark stays alone) of words, with a mark before those that are marked."""
        lead = (part & 0xC0) != 0x80
        places = np.flatnonzero(lead)
        b0 = part[places].astype(np.int64)
        size = np.where(b0 < 0x80, 1, np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4)))
        point = np.where(size == 1, b0, np.where(size == 2, b0 & 0x1F, np.where(size == 3, b0 & 0x0F, b0 & 0x07)))
        for k in range(1, 4):
            more = size > k
            point[more] = (point[more] << 6) | (part[np.minimum(places[more] + k, len(part) - 1)] & 0x3F)
        symbol = self.of_point[np.minimum(point, 0x10FFFF)]
        i, j = np.searchsorted(places, first), np.searchsorted(places, last)
        n = j - i
        take = K.ranges(i, n)
        body, width = symbol[take], size[take]
        ends = np.cumsum(n)
        unknown = np.concatenate([[0], np.cumsum(np.where(body < 0, width, 0))])
        spare = unknown[ends] - unknown[ends - n]
        body = np.insert(body, (ends - n)[marked], self.model.mark).astype(np.int32)
        count, head = self.merge(body, n + marked)
        return count + spare, marked & (head == self.model.mark)


def token_counts(docs: DataFrame, model: PieceModel, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens and over_limit."""
    id_type = docs.schema[id_col].dataType
    holder = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(holder.value)
        for part in K.pieces(batches, "text"):
            n = merger.counts(part.column("text"))
            size = np.diff(K.buffers(part.column("text"))[1])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)
