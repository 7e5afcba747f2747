"""Vectorised text kernels over Arrow buffers: words, hashes, window minima.

All functions work on UTF-8 bytes in place; no Python object is made for a
word. Callers pass a batch in slices of whole texts of a few megabytes, so
memory follows the slice, or the longest single text.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_C1, _C2, _K = U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U)
_LONG_WORD = 4096

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def _table(word: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(word)] = True
    return out


#: Bytes of words cut at white space, and of words of letters and digits (A-Z already lower-cased).
NOT_SPACE = ~_table(SPACES)
ALNUM = _table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function that gives freed memory back at its end.

    Workers live on between tasks, and an allocator would keep the most that
    any partition ever needed.
    """

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return tidied


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes, or a single longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(32))
    x *= _C1
    x ^= x >> U(29)
    x *= _C2
    x ^= x >> U(32)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, w[:-1]
    before[first[:n]] = False
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, w[1:]
    after[first[1:]] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one integer each (zeros past the end)."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    view, lens = _loads(data), ends - starts
    h = mix((view[starts] & _MASK[np.minimum(lens, 8)]) ^ (lens.astype(U) * _K))
    rest, at = np.flatnonzero((lens > 8) & (lens <= _LONG_WORD)), 8
    while rest.size:
        v = view[starts[rest] + at] & _MASK[np.minimum(lens[rest] - at, 8)]
        h[rest] = mix((h[rest] * _K) ^ v)
        at += 8
        rest = rest[lens[rest] > at]
    for i in np.flatnonzero(lens > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, dtype="<u8")[0]
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _K
        g += h[j : j + n]
    return mix(g)


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive bytes; k is a multiple of 8."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    view = _loads(data)
    g = mix(view[:n].astype(U))
    for at in range(8, k, 8):
        g = mix((g * _K) ^ view[at : at + n])
    return g


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of the least (the leftmost of equal ones).

    Values are compared by their upper 32 bits: the choice still depends on the
    window's content alone.
    """
    if len(values) < width:
        return np.zeros(0, np.int64)
    cur = (values & U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=U)
    span = 1
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < width:
        cur = np.minimum(cur[: len(cur) - (width - span)], cur[width - span :])
    return (cur & U(0xFFFFFFFF)).astype(np.int64)


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit values, by prefix sums of a polynomial modulo 2**64."""

    _base = U(0xB5297A4D3F84D5B5)
    _inverse = U(pow(0xB5297A4D3F84D5B5, -1, 1 << 64))
    _up = np.ones(1, dtype=U)
    _down = np.ones(1, dtype=U)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            out = []
            for base in (cls._base, cls._inverse):
                p = np.full(n, base, dtype=U)
                p[0] = 1
                out.append(np.cumprod(p, dtype=U))
            if n > 1 << 22:
                return out[0], out[1]
            cls._up, cls._down = out
        return cls._up[:n], cls._down[:n]

    def __init__(self, values: np.ndarray):
        up, self.down = self._powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * up[:-1], dtype=U, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(x ^ ((ends - starts).astype(U) * _K))


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: list i holds values[bounds[i]:bounds[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))
