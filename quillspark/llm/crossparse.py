"""Language by cross-parsing: suffix automata of labelled text count greedy longest-match phrases.

For each language a suffix automaton of a bounded reference (`reference` bytes of labelled texts) is
built and flattened to a table. A text is parsed against each: a phrase is the longest match with the
reference from where the last one ended; few phrases mean likeness (cross-parsing entropy). The score
weighs languages by 2 ** (-sharpness * phrases per byte); fewest phrases win, ties go to the smaller
code. Texts are read whole: lanes of `LANE` bytes are parsed at once as if each began a phrase, and then
the parse of the lane before is carried on until it meets the lane's own, so counts are the whole text's.

A reference holds excerpts of distinct texts (copies count once, however many there are), each of at most
`excerpt` bytes from anywhere in its text, until `reference` bytes are full. Only a language with less
labelled text than that has a shorter one; its phrases, which are shorter for that alone, are scaled by
what a phrase tells: log2 of the reference's bytes and 256 single symbols, against the longest reference.

Text is folded first: A-Z to lower case, any run of other ASCII bytes to one blank each byte, bytes that
no reference holds to one class that matches nothing.

Null texts, and texts without a letter, are `und` with score 0. Without labelled text all are `und`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared

LANE = 512

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Automaton:
    """The suffix automaton of a byte string: every substring is a path from state 0."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur

    def table(self, classes: np.ndarray, width: int) -> np.ndarray:
        """Flat int32 table: entry state * width + class holds (next state * width) * 2 + whether a phrase begins."""
        out = np.full((len(self.next), width), -1, np.int64)
        state = np.repeat(np.arange(len(self.next)), [len(x) for x in self.next])
        symbol = classes[np.array([c for x in self.next for c in x], np.int64)]
        out[state, symbol] = np.array([s for x in self.next for s in x.values()], np.int64)
        # without a path the symbol begins the next phrase, from the root; one that isn't there stays at the root
        root = np.maximum(out[0], 0)
        out = np.where(out >= 0, out * width * 2, root[None, :] * width * 2 + 1)
        out[0] = np.where(out[0] & 1, out[0], out[0] | 1)  # leaving the root always begins a phrase
        if out.max() >= 2**31:
            raise ValueError("the reference is too long for 32-bit states")
        return out.astype(np.int32).ravel()


class Parser:
    def __init__(self, references: dict[str, bytes]):
        self.langs = sorted(references)
        seen = sorted({c for r in references.values() for c in r})
        classes = np.full(256, len(seen), np.int64)
        classes[seen] = np.arange(len(seen))
        width = len(seen) + 1
        self.classes = classes[_FOLD].astype(np.int32)
        self.tables = [Automaton(references[x]).table(classes, width) for x in self.langs]
        bits = np.log2(np.array([len(references[x]) for x in self.langs]) + 256.0)
        self.weights = bits / bits.max(initial=1.0)

    def phrases(self, column: pa.Array) -> np.ndarray:
        """(rows, languages) phrase counts of the whole texts."""
        data, offsets = K.buffers(column)
        rows, size = len(offsets) - 1, np.diff(offsets)
        out = np.zeros((rows, len(self.langs)), np.int64)
        lanes = -(-size // LANE)
        row = np.repeat(np.arange(rows), lanes)
        begin = K.ranges(np.zeros(rows, np.int64), lanes) * LANE
        start = np.repeat(offsets[:-1], lanes) + begin
        length = np.minimum(LANE, offsets[1:][row] - start)
        counts = np.zeros((len(self.tables), len(row)), np.int32)
        finals = np.zeros((len(self.tables), len(row)), np.int32)
        for at in range(0, len(row), 8192):
            order = at + np.argsort(-length[at : at + 8192], kind="stable")
            s, n = start[order], length[order]
            # one column of symbols a step, lanes that have ended cut off the end
            live = np.searchsorted(-n, -np.arange(LANE), "left")
            symbols = self.classes[data[np.minimum(s[None, :] + np.arange(int(n[0]))[:, None], len(data) - 1)]]
            for k, table in enumerate(self.tables):
                state, count = np.zeros(len(s), np.int32), np.zeros(len(s), np.int32)
                for i in range(int(n[0])):
                    m = int(live[i])
                    to = table[state[:m] + symbols[i, :m]]
                    count[:m] += to & 1
                    state[:m] = to >> 1
                counts[k, order], finals[k, order] = count, state
        later = np.flatnonzero(begin > 0)
        for k, table in enumerate(self.tables):
            extra = self._carried(table, data, start, length, later, finals[k]) if len(later) else 0
            out[:, k] = np.bincount(row, counts[k] + extra, rows).astype(np.int64)
        return out

    def _carried(self, table: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, later: np.ndarray, final: np.ndarray) -> np.ndarray:
        """What each lane's count gains where the parse of the lane before goes on into it; `later` lanes follow one."""
        extra = np.zeros(len(start), np.int64)
        ends = final.copy()  # a lane's last state, once what comes before is known
        is_later = np.zeros(len(start) + 1, bool)
        is_later[later] = True
        todo = later
        while len(todo):
            old = ends[todo]
            own, carry, gain = np.zeros(len(todo), np.int32), ends[todo - 1], np.zeros(len(todo), np.int64)
            ends[todo] = final[todo]
            active, i = np.arange(len(todo)), 0
            while len(active):
                over = length[todo[active]] <= i
                if over.any():  # the parses never met here
                    ends[todo[active[over]]] = carry[active[over]]
                    active = active[~over]
                    continue
                symbol = self.classes[data[start[todo[active]] + i]]
                a, b = table[own[active] + symbol], table[carry[active] + symbol]
                gain[active] += (b & 1) - (a & 1)
                own[active], carry[active] = a >> 1, b >> 1
                active = active[(a >> 1) != (b >> 1)]
                i += 1
            extra[todo] = gain
            changed = todo[ends[todo] != old]
            todo = changed[is_later[changed + 1]] + 1
        return extra


_parsers: dict[int, Parser] = {}


def _parser(found: dict[str, bytes]) -> Parser:
    """The process's parser for these references."""
    key = hash(tuple(sorted(found.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(found)
    return _parsers[key]


def _least(held: dict[int, bytes], size: int) -> dict[int, bytes]:
    """The excerpts of least key that are needed for `size` bytes."""
    out, total = {}, 0
    for h in sorted(held):
        if total >= size:
            break
        out[h] = held[h]
        total += len(held[h]) + 1
    return out


def references(docs: DataFrame, learn: Column, text_col: str, lang_col: str, size: int, excerpt: int) -> dict[str, bytes]:
    """Per language `size` folded bytes, or all there are: excerpts of its distinct labelled texts, by least hash.

    Texts that fold alike are one text. A text gives at most `excerpt` bytes, from a place that its hash
    draws. Each task keeps what would fill the references from its rows alone, so what is gathered is
    bounded by one reference and one excerpt for each task and language; it is cut down again in a second
    round before the driver sees it.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def out(held: dict[str, dict[int, bytes]]) -> pa.RecordBatch:
        flat = [(name, h, x) for name, some in held.items() for h, x in some.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "x"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, bytes]] = {}
        for batch in K.pieces(batches, "text"):
            data, offsets = K.buffers(batch.column("text"))
            data = _FOLD[data].tobytes()
            for i, name in enumerate(batch.column("lang").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                if text.isspace() or not text:
                    continue
                h = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") >> 1
                at = h % (max(len(text) - excerpt, 0) + 1)
                held.setdefault(name, {})[h] = text[at : at + excerpt]
            held = {name: _least(some, size) for name, some in held.items()}
        yield out(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, bytes]] = {}
        for batch in batches:
            for name, h, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(name, {})[h] = x
            held = {name: _least(some, size) for name, some in held.items()}
        yield out(held)

    schema = "lang string, h long, x binary"
    parts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.isqrt(shared.scan_bytes(docs) >> 20) + 1)
    found: dict[str, dict[int, bytes]] = {}
    for r in rows.mapInArrow(draw, schema).repartition(parts).mapInArrow(merge, schema).collect():
        found.setdefault(r.lang, {})[r.h] = bytes(r.x)
    return {name: b" ".join(_least(some, size).values())[:size] for name, some in found.items()}


def languages(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reference: int = 32_768, excerpt: int = 512, sharpness: float = 60.0) -> DataFrame:
    """Per document: id, held_out, lang_pred and score in [0, 1]."""
    id_type = docs.schema[id_col].dataType
    learn = F.coalesce(learn, F.lit(False))
    found = references(docs, learn, text_col, lang_col, reference, excerpt)
    holder = docs.sparkSession.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(holder.value)
        names = np.array([*parser.langs, "und"], object)
        for batch in K.pieces(batches, "text"):
            text = batch.column("text")
            worded = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = np.maximum(np.diff(K.buffers(text)[1]), 1)
            if parser.langs:
                counts = parser.phrases(text) * parser.weights
                best = counts.argmin(axis=1)
                gap = (counts - counts.min(axis=1, keepdims=True)) / n[:, None]
                score = 1 / np.exp2(-sharpness * gap).sum(axis=1)
            else:
                best, score, worded = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n), bool)
            best = np.where(worded, best, len(parser.langs))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(names[best], pa.string()), pa.array(np.where(worded, score, 0.0))], ["id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), (~learn).alias("held"), F.col(text_col).alias("text")).mapInArrow(work, schema).withColumnRenamed("id", id_col)
