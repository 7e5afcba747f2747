"""Byte-level BPE by the ranks of a public vocabulary file.

Encoding of one piece: a segment tree over its byte positions holds, in every
node, the least (rank, position) of the pairs that start below it, so the root
is the leftmost pair of the lowest rank. A merge rewrites the pairs at the
merged position and at its live left neighbour and clears the dead one: three
point updates of logarithmic cost, however long the piece is.

The trees of many short pieces are the rows of one array, and every step of
theirs is taken by all rows at once; longer pieces are merged one by one.
Pieces repeat, so a bounded table of pieces keeps their ids. Whole texts are
always encoded; a null text is an empty one with no ids. Repeated rows are
encoded one by one, and extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship
from .textkernel import slices, text_buffer, tidy

#: Distinct pieces whose ids a worker keeps, and the longest such piece in characters.
CACHED_PIECES, CACHED_LENGTH = 400_000, 64
#: Bytes of texts whose pieces are looked up together, rows of one array of trees, and its widest tree in bytes.
SLICE_BYTES, TREES, WIDEST = 1 << 20, 1 << 14, 64
_NONE = 1 << 62


class Tokenizer:
    """Ranks, the pattern that cuts a text into pieces, and the way back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, ...]] = {}
        self._bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self._single = bool((self._bytes >= 0).all())
        pairs = {ranks[b[:k]] << 32 | ranks[b[k:]]: r for b, r in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}
        self._pairs = np.array(sorted(pairs), dtype=np.int64)
        self._merged = np.array([pairs[k] for k in self._pairs.tolist()], dtype=np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two tokens as one, or _NONE."""
        key = left << 32 | right
        if not len(self._pairs):
            return np.full(key.shape, _NONE)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._merged[at], _NONE)

    def _trees(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """The ids of pieces of at most ``size`` bytes, a power of two; a row of the arrays is a piece."""
        m, shift = len(pieces), size.bit_length()
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(m, size)
        ids = np.zeros((m, size + 1), dtype=np.int64)
        ids[:, :size] = self._bytes[raw]
        place = np.arange(size)
        live = place < n[:, None]
        after = np.broadcast_to(np.arange(1, size + 2), (m, size + 1)).copy()  # the next live position; n at the end
        before = np.broadcast_to(np.arange(-1, size), (m, size + 1)).copy()
        value = lambda ranks, at: np.where(ranks == _NONE, _NONE, ranks << shift | at)
        tree = np.full((m, 2 * size), _NONE)
        tree[:, size : 2 * size - 1] = np.where(place[:-1] < n[:, None] - 1, value(self._ranks(ids[:, : size - 1], ids[:, 1:size]), place[:-1]), _NONE)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        row = np.arange(m)

        def put(row: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
            v = at + size
            tree[row, v] = new
            for _ in range(shift - 1):
                v >>= 1
                tree[row, v] = np.minimum(tree[row, 2 * v], tree[row, 2 * v + 1])

        while True:
            least = tree[row, 1]
            row, least = row[least != _NONE], least[least != _NONE]
            if not len(row):
                break
            i = least & (1 << shift) - 1
            gone = after[row, i]
            stop = after[row, gone]
            whole = least >> shift
            ids[row, i] = whole
            after[row, i] = stop
            before[row, stop] = i
            live[row, gone] = False
            put(row, gone, _NONE)
            put(row, i, np.where(stop < n[row], value(self._ranks(whole, ids[row, stop]), i), _NONE))
            j = before[row, i]
            some = j >= 0
            r, j = row[some], j[some]
            put(r, j, value(self._ranks(ids[r, j], whole[some]), j))
        flat = ids[:, :size][live].tolist()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_all(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each piece."""
        out: dict[str, tuple[int, ...]] = {}
        waiting: dict[int, list[tuple[str, bytes]]] = {}
        get = self.ranks.get
        for piece in pieces:
            raw = piece.encode()
            whole = get(raw)
            if whole is not None:
                out[piece] = (whole,)
            elif len(raw) > WIDEST or not self._single:
                out[piece] = self.merge(raw)
            else:
                waiting.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, of in waiting.items():
            for k in range(0, len(of), TREES):
                part = of[k : k + TREES]
                out.update(zip([x for x, _ in part], self._trees([raw for _, raw in part], size), strict=True))
        return out

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        shift = n.bit_length()
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for v in range(size - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b
        end = list(range(1, n + 1))  # of the token that starts at a live position
        left = list(range(-1, n - 1))  # its live left neighbour
        where = (1 << shift) - 1

        def put(i: int, value: int) -> None:
            v = size + i
            tree[v] = value
            while v > 1:
                a, b = tree[v], tree[v ^ 1]
                v >>= 1
                least = a if a < b else b
                if tree[v] == least:
                    return
                tree[v] = least

        while tree[1] != _NONE:
            i = tree[1] & where
            gone = end[i]
            stop = end[i] = end[gone]
            put(gone, _NONE)
            if stop < n:
                left[stop] = i
                r = get(piece[i : end[stop]])
                put(i, _NONE if r is None else r << shift | i)
            else:
                put(i, _NONE)
            j = left[i]
            if j >= 0:
                r = get(piece[j:stop])
                put(j, _NONE if r is None else r << shift | j)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts, without special tokens."""
        cut = [self.split(t) for t in texts]
        distinct = set().union(*cut)
        new = self.merge_all(distinct.difference(self.known))
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known = {p: self.known[p] for p in distinct.intersection(self.known)}
        kept = {p: ids for p, ids in new.items() if len(p) <= CACHED_LENGTH}
        self.known.update(kept)
        of = self.known if len(kept) == len(new) else self.known | new
        return [list(chain.from_iterable(map(of.__getitem__, pieces))) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without special tokens."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer for each worker process and file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer.load(path, pattern)
    return _loaded[path, pattern]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the second column, have about a megabyte together, or a single longer one."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(1))
        for a, b in slices(offsets, SLICE_BYTES):
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every text."""
    ship(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for part in _parts(batches):
            ids = tok.encode_all([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the ``bytes`` that each row's ids stand for (null ids: empty)."""
    ship(encoded.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [tok.decode(ids or []) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=[key, "bytes"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to; encoded and decoded in one pass.

    ids: also the ids themselves.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        text_of = tok.text_of.__getitem__
        for part in _parts(batches):
            rows = []
            every = tok.encode_all([t or "" for t in part.column(1).to_pylist()])
            for found in every:
                told = ",".join(map(text_of, found)).encode()
                rows.append((len(found), hashlib.sha256(told).hexdigest(), hashlib.sha256(tok.decode(found)).hexdigest()))
            n, a, b = zip(*rows, strict=True)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)] + [pa.array(every, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
