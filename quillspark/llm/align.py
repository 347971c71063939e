"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

A text is encoded by A (a byte-level BPE with the usual word pattern) and by B (a BPE of pieces with a word
mark). The transducer reads both token sequences once. Its state is the side that leads and the leading
token's bytes that the other side hasn't matched yet; the next token of the side behind either shortens that
residual, closes the group where it uses the residual up, or takes the lead with what it has beyond it.
Transitions are remembered by residual and next token. Each step but a group's first is a link: the two
tokens' byte ranges overlap.

A single blank between two characters that are no white space ends a token on both sides, and neither
tokenizer looks across it. So texts are cut there, a worker runs each distinct stretch once and remembers its
groups and links (`remembered` stretches at a time; stretches are told apart by a 64-bit hash, two of a
million share one with a chance of 3e-8), and a text's result is the sequence of its stretches' results.

1. One map encodes all texts; each row's distinct id pairs are written with their counts.
2. Pairs are counted over the corpus from what was written, within tasks first.
3. The most frequent pairs, at most `held` (17 bytes each, in each worker), answer within a second map; links
   of rarer pairs, if there are any, are joined by pair and summed by row.

Texts that are null or empty, or whose tokens don't join to a blank and the text (those with U+2581), have no
tokens: zeros, and '' for the groups. Each row is a text of its own, also where ids are null or repeat. Very
long texts are encoded whole; a stretch without a blank is one call of each tokenizer. An empty table gives
no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quillspark.llm import kernel as K
from quillspark.llm import shared

U64 = np.uint64
MARK = "▁"
LONG = 4096  # bytes beyond which a stretch is hashed by itself
MANY = 400  # tokens beyond which it is run by itself

# fixed value: the word pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# leading bytes of characters that are never white space
_SOLID = np.zeros(256, dtype=bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE0] = True
_SOLID[[0xE0, *range(0xE4, 0xF0), *range(0xF0, 0xF5)]] = True


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}


def a_bytes(spec: dict) -> dict[int, bytes]:
    letters = byte_letters()
    return {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items()}


def b_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(MARK, " ").encode()


def check_a(spec: dict) -> None:
    """Raises where A might look across a single blank."""
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        raise ValueError("A must be a byte-level BPE with the usual word pattern and no normaliser")
    if any(not t.get("special") for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens of A must be special ones")
    vocab, merges = spec["model"]["vocab"], (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
    if any(vocab["".join(m)] != 256 + k for k, m in enumerate(merges)):
        raise ValueError("A's ids must follow its merges")


def check_b(model: bytes) -> int:
    """The bits of B's ids; raises where B might look across a single blank, or lose bytes."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("B must be a BPE with byte fallback, an identity normaliser and a dummy prefix")
    if any(p.type == 4 or (p.type == 1 and MARK in p.piece.lstrip(MARK)) for p in proto.pieces):
        raise ValueError("B has pieces that cross a blank")
    return (len(proto.pieces) - 1).bit_length()


class Transducer:
    """Groups and links of two token sequences over the same bytes.

    A state is the leading side and its residual; state 0 is the empty residual. Transitions by (state, next
    token of the side behind) are remembered; -1 is where the bytes differ.
    """

    def __init__(self, a_token: dict[int, bytes], b_token: dict[int, bytes]):
        self.tokens = (a_token, b_token)
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple[bool, bytes]] = [(False, b"")]  # whether A leads, residual
        self.numbers: dict[tuple[bool, bytes], int] = {(True, b""): 0, (False, b""): 0}
        self.steps: dict[int, int] = {}
        self.sorted: tuple[np.ndarray, np.ndarray] | None = None

    def state(self, a_leads: bool, residual: bytes) -> int:
        found = self.numbers.setdefault((a_leads, residual), len(self.states))
        if found == len(self.states):
            self.states.append((a_leads, residual))
        return found

    def step(self, state: int, token: int) -> int:
        key = state << 32 | token
        found = self.steps.get(key)
        if found is None:
            a_leads, residual = self.states[state]
            new = self.tokens[1 if a_leads else 0][token]
            if residual.startswith(new):
                found = self.state(a_leads, residual[len(new) :])
            elif new.startswith(residual):
                found = self.state(not a_leads, new[len(residual) :])
            else:
                found = -1
            self.steps[key] = found
            self.sorted = None
        return found

    def moved(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The same for many at once."""
        key = state << 32 | token
        for again in (False, True):
            if self.sorted is None:
                known = np.fromiter(self.steps, np.int64, len(self.steps))
                order = np.argsort(known)
                self.sorted = known[order], np.fromiter(self.steps.values(), np.int64, len(known))[order]
            known, to = self.sorted
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            missing = known[at] != key if len(known) else np.ones(len(key), bool)
            if again or not missing.any():
                return to[at]
            for k in np.unique(key[missing]).tolist():
                self.step(k >> 32, k & 0xFFFFFFFF)
        raise AssertionError

    def run(self, a_ids: list[int], b_ids: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]]] | None:
        """(groups, links) of one pair of sequences, or None where the two don't join to the same bytes."""
        groups, links = [], []
        i, j, m, n = 0, 0, len(a_ids), len(b_ids)
        while i < m:
            i0, j0, lead = i, j, a_ids[i]
            i += 1
            state, a_leads = self.state(True, self.tokens[0][lead]), True
            while state:
                if (j == n) if a_leads else (i == m):
                    return None
                if a_leads:
                    t = b_ids[j]
                    j += 1
                    links.append((lead, t))
                else:
                    t = a_ids[i]
                    i += 1
                    links.append((t, lead))
                state = self.step(state, t)
                if state < 0:
                    return None
                if state and self.states[state][0] != a_leads:
                    a_leads, lead = not a_leads, t
            groups.append((a_ids[i0:i], b_ids[j0:j]))
        return (groups, links) if j == n else None

    def run_many(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of many pairs of sequences, one token of each in a round: (valid, A's and B's group starts, links as sequence and both tokens)."""
        count = len(a_at) - 1
        valid = np.zeros(count, bool)
        a_start, b_start = np.zeros(len(a), bool), np.zeros(len(b) + 1, bool)
        who = np.arange(count)
        i, j = a_at[:-1].copy(), b_at[:-1].copy()
        state, lead, a_leads = (np.zeros(count, np.int64) for _ in range(3))
        first = {t: self.state(True, self.tokens[0][t]) for t in np.unique(a).tolist()}
        ids = np.array(sorted(first), np.int64)
        begun = np.array([first[t] for t in ids.tolist()], np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
        while len(who):
            idle = state == 0
            ended = idle & (i == a_at[who + 1])
            if ended.any():
                valid[who[ended]] = j[ended] == b_at[who[ended] + 1]
                who, i, j, state, lead, a_leads, idle = (x[~ended] for x in (who, i, j, state, lead, a_leads, idle))
            if idle.any():
                token = a[i[idle]]
                a_start[i[idle]] = b_start[j[idle]] = True
                lead[idle], a_leads[idle] = token, 1
                state[idle] = begun[np.searchsorted(ids, token)]
                i[idle] += 1
            ready = np.where(a_leads == 1, j < b_at[who + 1], i < a_at[who + 1])
            if not ready.all():
                who, i, j, state, lead, a_leads = (x[ready] for x in (who, i, j, state, lead, a_leads))
            if not len(who):
                break
            from_b = a_leads == 1
            token = np.where(from_b, b[np.minimum(j, len(b) - 1)], a[np.minimum(i, len(a) - 1)])
            out.append((who, np.where(from_b, lead, token), np.where(from_b, token, lead)))
            j, i = j + from_b, i + ~from_b
            state = self.moved(state, token)
            alike = state >= 0
            if not alike.all():
                who, i, j, state, lead, a_leads, token = (x[alike] for x in (who, i, j, state, lead, a_leads, token))
            leads = np.array([s[0] for s in self.states], np.int64)[state] if len(who) else a_leads
            change = (leads != a_leads) & (state > 0)
            lead, a_leads = np.where(change, token, lead), np.where(change, leads, a_leads)
        who, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(who, kind="stable")
        return valid, a_start, b_start[:-1], (who[order], x[order], y[order])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches between single blanks, and each row's offsets into them."""
    at = np.flatnonzero(data == 32)
    if len(at):
        row = np.searchsorted(offsets, at, "right") - 1
        at = at[(at > offsets[row]) & (at + 1 < offsets[row + 1])]
        before = at - 1
        for _ in range(3):
            inside = (data[before] & 0xC0) == 0x80
            before = before - inside
        lead, after = data[before], data[at + 1]
        wide = ((lead == 0xE3) & (data[np.minimum(before + 1, len(data) - 1)] != 0x80), (after == 0xE3) & (data[np.minimum(at + 2, len(data) - 1)] != 0x80))
        at = at[(_SOLID[lead] | wide[0]) & (_SOLID[after] | wide[1])]
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.sort(np.concatenate([filled, at + 1]))
    ends = np.sort(np.concatenate([offsets[1:][np.diff(offsets) > 0], at]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch's bytes."""
    out = np.zeros(len(starts), U64)
    long = ends - starts > LONG
    short = np.where(long, starts, ends)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + K.PIECE)))
        base, to = int(starts[i]), int(short[i:j].max())
        power, inverse = K.powers(to - base + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(to - base + 1, U64)
            np.cumsum((data[base:to].astype(U64) + U64(1)) * power[: to - base], out=total[1:])
            out[i:j] = K.mix((total[short[i:j] - base] - total[starts[i:j] - base]) * inverse[starts[i:j] - base])
        i = j
    for k in np.flatnonzero(long):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Aligner:
    """Both tokenizers of one worker, and the stretches that it remembers.

    A runs in tiktoken on the vocabulary of its file: the same tokens, several times as fast as the file's own
    library.
    """

    def __init__(self, a_json: str, b_model: bytes, remembered: int):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        letters = a_bytes(json.loads(a_json))
        self.a = Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in letters.items()}, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=b_model)
        pieces = {i: b_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.vocab_size())}
        self.transducer = Transducer(letters, pieces)
        self.spelt = tuple(np.array([[f"{i}{end}" for i in range(max(t) + 1)] for end in ends], object) for t, ends in ((letters, ",|"), (pieces, ",;")))
        self.a_size = np.zeros(max(letters) + 1, np.int64)
        self.a_size[list(letters)] = [len(b) for b in letters.values()]
        self.shift = max(pieces).bit_length()
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.texts: list[str] = []
        self.size = 0
        self.pair_ids: dict[int, int] = {}
        self.sums: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, whether valid
        self.links: list[np.ndarray] = []

    def learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Runs new stretches; those of many tokens one by one, the others in rounds."""
        if len(self.transducer.steps) > 500_000:
            self.transducer.forget()
        count, size = len(starts), ends - starts
        # all stretches with a blank before each; neither tokenizer looks across it
        joined = np.full(int(size.sum()) + count, 32, np.uint8)
        to = np.cumsum(size + 1)
        joined[K.ranges(to - size, size)] = data[K.ranges(starts, size)]
        text = joined.tobytes().decode()
        chars = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
        cut = list(zip((chars[to - size]).tolist(), chars[to].tolist(), strict=True))
        a = np.array(self.a.encode_ordinary(text), np.int64)
        a_at = np.concatenate([[0], np.searchsorted(np.cumsum(self.a_size[a]), to, "left") + 1])
        b_ids = self.b.encode([text[p:q] for p, q in cut], num_threads=1)
        b_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, b_ids), np.int64, count))])
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_at[-1]))
        la, lb = np.diff(a_at), np.diff(b_at)
        long = la + lb > MANY
        alone = {k: self.transducer.run(a[a_at[k] : a_at[k + 1]].tolist(), b_ids[k]) for k in np.flatnonzero(long).tolist()}
        if alone:
            a, b = a[np.repeat(~long, la)], b[np.repeat(~long, lb)]
            a_at, b_at = (np.concatenate([[0], np.cumsum(np.where(long, 0, x))]) for x in (la, lb))
        valid, a_start, b_start, (who, x, y) = self.transducer.run_many(a, a_at, b, b_at)
        texts = self.written(a, a_at, a_start, b, b_at, b_start, valid)
        groups = np.concatenate([[0], np.cumsum(a_start)])
        sums = np.stack([la, lb, groups[a_at[1:]] - groups[a_at[:-1]], np.bincount(who, minlength=count), valid], axis=1).astype(np.int64)
        keys = x << self.shift | y
        for k, found in alone.items():
            valid[k] = sums[k, 4] = found is not None
            if found:
                texts[k] = "".join(f"{','.join(map(str, p))}|{','.join(map(str, q))};" for p, q in found[0])
                sums[k, 2:4] = len(found[0]), len(found[1])
        sums[~valid] = 0
        if not valid.all():
            who, keys = who[valid[who]], keys[valid[who]]
        if alone:
            more = [(k, p << self.shift | q) for k, found in alone.items() if found for p, q in found[1]]
            who, keys = (np.concatenate([x, np.array([m[i] for m in more], np.int64)]) for i, x in enumerate((who, keys)))
            keys = keys[np.argsort(who, kind="stable")]
        kinds, inverse = np.unique(keys, return_inverse=True)
        ids = np.array([self.pair_ids.setdefault(k, len(self.pair_ids)) for k in kinds.tolist()], np.int32)
        self.texts.extend(texts)
        self.size += sum(map(len, texts))
        self.sums.append(sums.astype(np.int32) if not alone else sums)
        self.links.append(ids[inverse] if len(keys) else np.zeros(0, np.int32))

    def written(self, a, a_at, a_start, b, b_at, b_start, valid) -> list[str]:
        """Each sequence's groups, `a1,a2|b1;` each."""
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        last_a[:-1], last_b[:-1] = a_start[1:], b_start[1:]
        last_a[a_at[1:][np.diff(a_at) > 0] - 1] = last_b[b_at[1:][np.diff(b_at) > 0] - 1] = True
        who_a, who_b = (np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (a_at, b_at))
        ok_a, ok_b = valid[who_a], valid[who_b]
        # both sides of valid sequences have the same groups
        place = np.concatenate([np.cumsum(a_start[ok_a]) * 2, np.cumsum(b_start[ok_b]) * 2 + 1])
        order = np.argsort(place, kind="stable")
        parts = np.concatenate([self.spelt[0][last_a[ok_a].astype(np.int64), a[ok_a]], self.spelt[1][last_b[ok_b].astype(np.int64), b[ok_b]]])[order]
        who = np.concatenate([who_a[ok_a], who_b[ok_b]])[order]
        whole = "".join(parts.tolist())
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(np.bincount(who, size, len(valid)).astype(np.int64)).tolist()
        return [whole[p:q] for p, q in zip([0, *ends], ends, strict=False)]

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each stretch among those known; new ones are learnt."""
        keys, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        known = self.known
        ids = np.array([known.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(ids < 0)
        ids[new] = np.arange(len(known), len(known) + len(new))
        known.update(zip(keys[new].tolist(), ids[new].tolist(), strict=True))
        at, bytes_to = 0, np.cumsum((ends - starts)[first[new]])
        while at < len(new):  # about a megabyte at a time, or one longer stretch
            to = max(at + 1, int(np.searchsorted(bytes_to, (bytes_to[at - 1] if at else 0) + K.PIECE, "right")))
            self.learn(data, starts[first[new[at:to]]], ends[first[new[at:to]]])
            at = to
        return ids[inverse]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, offsets into the links, links as pair numbers) of the known stretches."""
        if len(self.sums) != 1:
            self.sums = [np.concatenate([np.zeros((0, 5), np.int32), *self.sums])]
            self.links = [np.concatenate([np.zeros(0, np.int32), *self.links])]
        return self.sums[0], np.concatenate([[0], np.cumsum(self.sums[0][:, 3], dtype=np.int64)]), self.links[0]

    def rows(self, texts: pa.Array, hashed: bool) -> tuple[np.ndarray, list[str], pa.Array, pa.Array]:
        """Of each text: its sums, its groups, and its distinct pairs with their counts, as 8-byte and 4-byte numbers."""
        if len(self.known) > self.remembered or self.size > 1 << 26:
            self.forget()
        data, offsets = K.buffers(texts)
        starts, ends, at = stretches(data, offsets)
        ids = self.look(data, starts, ends)
        sums, bounds, links = self.tables()
        per = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(sums[ids], axis=0, dtype=np.int64)])
        total = per[at[1:]] - per[at[:-1]]
        good = (total[:, 4] == np.diff(at)) & (np.diff(at) > 0)
        total[~good] = 0
        parts, groups = self.texts, []
        for k in range(len(at) - 1):
            if not good[k]:
                groups.append("")
                continue
            text = "".join([parts[i] for i in ids[at[k] : at[k + 1]].tolist()])[:-1]
            groups.append(hashlib.sha256(text.encode()).hexdigest() if hashed else text)
        keys = np.fromiter(self.pair_ids, np.int64, len(self.pair_ids))
        place = np.empty(len(keys), np.int64)
        place[np.argsort(keys)] = np.arange(len(keys))
        keys = np.sort(keys)
        width, sizes = max(len(keys), 1), bounds[ids + 1] - bounds[ids]
        ends_of = np.concatenate([[0], np.cumsum(sizes)])
        each, pairs, times = [], [], []
        low = 0
        while low < len(good):  # rows whose counts of all pairs, and whose links, fit 2,000,000 numbers; at least one
            high = min(len(good), low + max(1, 2_000_000 // width))
            high = max(low + 1, low + int(np.searchsorted(ends_of[at[low + 1 : high + 1]], ends_of[at[low]] + 2_000_000, "right")))
            mine = slice(at[low], at[high])
            row = np.repeat(np.repeat(np.arange(high - low), np.diff(at[low : high + 1])), sizes[mine])
            cell = row * width + place[links[K.ranges(bounds[ids[mine]], sizes[mine])]]
            n = np.bincount(cell, minlength=(high - low) * width).reshape(high - low, width)
            n[~good[low:high]] = 0
            row, pair = np.nonzero(n)
            each.append(np.bincount(row, minlength=high - low))
            pairs.append(keys[pair])
            times.append(n[row, pair].astype(np.int32))
            low = high
        to = np.concatenate([[0], np.cumsum(np.concatenate(each))]) if each else np.zeros(1, np.int64)
        return total, groups, *(_binary(np.concatenate([np.zeros(0, kind), *x]), to) for x, kind in ((pairs, np.int64), (times, np.int32)))


def _binary(values: np.ndarray, to: np.ndarray) -> pa.Array:
    """Rows of bytes of the values between the offsets."""
    at = (to * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


_aligners: dict[str, Aligner] = {}


def _aligner(a_json: str, b_model: bytes, remembered: int) -> Aligner:
    key = hashlib.sha256(a_json.encode() + b_model + str(remembered).encode()).hexdigest()
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a_json, b_model, remembered)
    return _aligners[key]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the rows' pairs, added up within the task."""
    keys, counts, waiting = [], [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        cut = K.segments(k)
        return k[cut], np.add.reduceat(n, cut)

    def out(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        keys.append(K.buffers(batch.column("pairs"))[0].view(np.int64))
        counts.append(K.buffers(batch.column("times"))[0].view(np.int32).astype(np.int64))
        waiting += len(keys[-1])
        if waiting > 2_000_000:
            k, n = added()
            if len(k) > 1_000_000:
                yield out(k, n)
                k, n = k[:0], n[:0]
            keys, counts, waiting = [k], [n], len(k)
    if waiting:
        yield out(*added())


def aligned(table: DataFrame, a_json: str, b_model: bytes, *, id_col: str = "doc_id", text_col: str = "text", remembered: int = 600_000, held: int = 1 << 20, hashed: bool = True) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256 (hashed) or groups."""
    check_a(json.loads(a_json))
    shift = check_b(b_model)
    spark = table.sparkSession
    files = spark.sparkContext.broadcast((a_json, b_model))  # two vocabularies
    groups = "groups_sha256" if hashed else "groups"
    source = table.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _aligner(*files.value, remembered)
        for batch in K.pieces(batches, "text"):
            total, text, pairs, times = worker.rows(batch.column("text"), hashed)
            sums = [pa.array(np.ascontiguousarray(total[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *sums, pa.array(text, pa.large_string()), pairs, times], ["id", "n_a", "n_b", "n_groups", "n_links", groups, "pairs", "times"])

    longs = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    made = T.StructType([source.schema["id"], *longs, T.StructField(groups, T.StringType()), T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType())])
    rows = shared.keep(source.mapInArrow(encode, made).withColumn("row", F.monotonically_increasing_id()), "align-rows")

    counted = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    pairs = shared.keep(rows.select("pairs", "times").mapInArrow(_count_pairs, counted).groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    b_of = F.col("pair").bitwiseAND((1 << shift) - 1)
    most = pairs.groupBy(b_of.alias("b")).agg(F.max("n").alias("most"))
    pairs = pairs.withColumn("b", b_of).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    least = _least_held(pairs, held)
    top = pairs.where(F.col("n") >= least).toArrow() if least is not None else pairs.limit(0).toArrow()  # at most `held` rows
    order = np.argsort(top["pair"].to_numpy())
    frequent = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = frequent.value
        for batch in batches:
            pairs, to = K.buffers(batch.column("pairs"))
            pairs, to = pairs.view(np.int64), to // 8
            m = K.buffers(batch.column("times"))[0].view(np.int32).astype(np.int64)
            at = np.minimum(np.searchsorted(key, pairs), max(len(key) - 1, 0))
            found = key[at] == pairs if len(key) else np.zeros(len(pairs), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(found, m * x[at], 0) if len(key) else m * 0)]) for x in (n, best)]
            more = np.concatenate([[0], np.cumsum(~found)]).astype(np.int32)
            kept = [batch.column(c) for c in ("row", "id", "n_a", "n_b", "n_groups", "n_links", groups)]
            rest = [pa.ListArray.from_arrays(pa.array(more[to]), pa.array(x[~found])) for x in (pairs, m)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[1][to[1:]] - sums[1][to[:-1]]), pa.array(sums[0][to[1:]] - sums[0][to[:-1]]), *rest], answered.names)

    listed = T.ArrayType(T.LongType())
    answered = T.StructType([rows.schema["row"], rows.schema["id"], *longs, rows.schema[groups], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", listed), T.StructField("rest_times", listed)])
    out = rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", groups, "pairs", "times").mapInArrow(answer, answered)
    if pairs.where(F.col("n") < least).limit(1).count() if least is not None else pairs.limit(1).count():
        out = shared.keep(out, "align-answers")
        links = out.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("m"))
        rare = pairs.where(F.col("n") < least) if least is not None else pairs
        more = links.join(rare, "pair").groupBy("row").agg(F.sum(F.col("m") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"))
        out = out.join(more, "row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups)


def _least_held(pairs: DataFrame, held: int) -> int | None:
    """The least power of two so that at most `held` pairs have that count or more; None if even the commonest are too many."""
    power = F.length(F.bin("n")) - 1
    sizes = pairs.groupBy(power.alias("power")).agg(F.count("*").alias("m")).collect()  # at most 63 rows
    least, total = None, 0
    for power, m in sorted(((r.power, r.m) for r in sizes), reverse=True):
        total += m
        if total > held:
            break
        least = 1 << power
    return least if sizes else 1
