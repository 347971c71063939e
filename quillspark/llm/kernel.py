"""NumPy kernels shared by the operators: word hashing over Arrow buffers and packed integer arrays.

Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased. A word's key is a
64-bit polynomial hash of its bytes, finished by a bijective mixer, so equal words always have equal
keys; for a billion distinct words about 0.03 collisions are expected.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_PI = U64(pow(int(_P), -1, 1 << 64))
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _P)]))
            _inv = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _PI)]))
    return _pow, _inv


def trim() -> None:
    """Gives freed memory back to the system, so that what a worker holds is what it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two keys."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ U64(0xA0761D6478BD642F)))


def of_word(word: bytes) -> int:
    """The key of one word, as ``words`` gives it."""
    return int(words(pa.array([word.decode("utf-8", "surrogateescape")]))[0][0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about `size` bytes of a column (a longer row by itself)."""
    for batch in batches:
        at, total = 0, np.cumsum(np.diff(buffers(batch.column(column))[1]))
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        trim()


def cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that cut no word."""
    at, end = 0, len(data)
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:  # inside one long row: cut before a word
                gaps = np.flatnonzero(~word[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    row_end = int(offsets[k + 1])
                    while to < row_end and word[data[to]]:
                        more = np.flatnonzero(~word[data[to : min(to + PIECE, row_end)]])
                        to = to + int(more[0]) if len(more) else min(to + PIECE, row_end)
        yield at, to
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, at: int, to: int, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, within data[at:to], of the words there."""
    inside = word[data[at:to]]
    edges = offsets[(offsets >= at) & (offsets <= to)] - at
    before = np.zeros(to - at, dtype=bool)
    before[1:] = inside[:-1]
    before[edges[edges < to - at]] = False
    after = np.zeros(to - at, dtype=bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words in order, and each row's offsets into them (rows + 1)."""
    data, offsets = buffers(column)
    keys, starts = [], []
    for at, to in cuts(data, offsets):
        first, last = spans(data, offsets, at, to)
        if not len(first):
            continue
        power, inverse = powers(to - at + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(to - at + 1, U64)
            np.cumsum((_LOWER[data[at:to]].astype(U64) + U64(1)) * power[: to - at], out=total[1:])
            keys.append(mix((total[last] - total[first]) * inverse[first]))
        starts.append(first + at)
    if not keys:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    return np.concatenate(keys), np.searchsorted(np.concatenate(starts), offsets)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, the empty upper planes left out, then compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    if not len(values):
        return bytes(12)
    planes = max(1, (int(values.max()).bit_length() + 7) // 8)
    body = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    squeezed = pa.compress(body, "zstd", asbytes=True)
    return np.array([len(values), planes, len(squeezed)], "<u4").tobytes() + squeezed


def unpack(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The next packed array and where it ends."""
    n, planes, size = (int(x) for x in np.frombuffer(data, "<u4", 3, at))
    if not n:
        return np.zeros(0, U64), at + 12
    body = np.frombuffer(pa.decompress(memoryview(data)[at + 12 : at + 12 + size], n * planes, "zstd", asbytes=True), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = body.reshape(planes, n).T
    return out.view("<u8").reshape(-1), at + 12 + size


def pack_sorted(values: np.ndarray) -> bytes:
    values = np.asarray(values, U64)
    return pack(np.diff(values, prepend=U64(0)))


def unpack_sorted(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    gaps, at = unpack(data, at)
    return np.cumsum(gaps, dtype=U64), at


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[segments(values)]


def segments(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each s, n."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
