"""Suffix-array dedup: a sparse suffix order by a common-prefix-aware distributed merge sort.

Repeated strings of ``width`` bytes lie in anchored segments with one anchor
hash (see ``anchors``), so it is enough to sort the suffixes that start at
shared anchors, each once per distinct segment. Every map task sorts its
suffixes into runs and front-codes them: a suffix is the length of its common
prefix with the one before it and the rest. The runs of a shard are exchanged
and combined by a loser tree whose nodes remember the common prefix with the
last string put out; known prefixes are never compared again, and the merge
yields the common prefix of neighbours as it goes.

A window with its anchor at offset o repeats if another segment agrees in
width - o bytes from the anchor on and in o bytes before it: both are classes
of neighbours in sorted order, forwards from the merge and backwards.

Beside what is removed, shorter strings that *another document* has are
reported: a passage of little more than 50 words is often shorter than 400
bytes. Anchors and windows are those of the shorter strings; the suffixes go on
to the length of the longer ones, so one sorted order decides both. The least
and the greatest document of a class tell whether two documents have it.

Defined results: a null text is empty; texts shorter than ``width`` bytes keep
everything; equal rows are copies of each other, so both lose what they share;
rows without doc_id take part like any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import textkernel as tk
from .grouping import apart, block_units
from .session import cut, ship

WIDTH, GRAM = 400, 32
#: What is reported as shared with another document: 50 words of six bytes, a space included.
SHARED = 300
SHARD_BYTES, RUN_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20, 8 << 20
_HEAD = 16  # bytes of a sort key before the suffix: anchor and work unit


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    while known < n:
        stop = min(known + 64, n)
        x, y = a[known:stop], b[known:stop]
        if x != y:
            diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return stop - (diff.bit_length() + 7) // 8
        known = stop
    return n


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """(common prefix with the key before, the rest) of sorted keys."""
    lcps, rests, before = [], [], b""
    for k in keys:
        h = common_prefix(before, k, 0)
        lcps.append(h)
        rests.append(k[h:])
        before = k
    return lcps, rests


def decode_run(lcps: list[int], rests: list[bytes]) -> Iterator[tuple[bytes, int]]:
    before = b""
    for h, rest in zip(lcps, rests, strict=True):
        before = before[:h] + rest
        yield before, h


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(key, common prefix with the key before, its run) in sorted order, from sorted runs of (key, common prefix).

    A loser tree: each inner node keeps the contender that lost there and its
    common prefix with the last winner. A contender with the longer known
    prefix is the smaller; only equal prefixes are compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    its = runs + [iter(())] * (k - len(runs))
    key: list[bytes | None] = [None] * k
    lcp = [0] * k
    for i, it in enumerate(its):
        first = next(it, None)
        if first is not None:
            key[i] = first[0]
    loser = [-1] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's prefix becomes the one with the winner."""
        x, y = key[i], key[j]
        if x is None:
            return j, i
        if y is None:
            return i, j
        a, b = lcp[i], lcp[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        h = common_prefix(x, y, a)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            lcp[j] = h
            return i, j
        lcp[i] = h
        return j, i

    heads = list(range(k))
    for size in iter(lambda: len(heads), 1):
        up = []
        for n in range(size // 2):
            win, lost = play(heads[2 * n], heads[2 * n + 1])
            loser[size // 2 + n] = lost
            up.append(win)
        heads = up
    win = heads[0]
    while key[win] is not None:
        yield key[win], lcp[win], win
        nxt = next(its[win], None)
        key[win], lcp[win] = nxt if nxt is not None else (None, 0)
        node = (win + k) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


_RUN = "shard long, lcps array<int>, rests array<binary>, seg array<long>, copies array<long>, lo array<long>, hi array<long>, at array<int>, wins array<int>, wide array<int>, back array<binary>"


def _make_runs(texts: DataFrame, wanted: DataFrame, extent: int, shards: int, run_bytes: int) -> DataFrame:
    """Sorted, front-coded runs of the wanted suffixes for every shard."""
    per_text = wanted.groupBy("doc", "rid").agg(F.collect_list(F.struct("anchor", "a", "b", "seg", "copies", "lo", "hi", "start", "wins", "at", "wide")).alias("wanted"))

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort()
        a = 0
        while a < len(held):
            b = a
            while b < len(held) and held[b][0] == held[a][0]:
                b += 1
            part = held[a:b]
            lcps, rests = front_code([x[1] for x in part])
            columns = [[part[0][0]], [lcps], [rests], *([[x[i] for x in part]] for i in range(2, 10))]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 4, *[pa.list_(pa.int32())] * 3, pa.list_(pa.binary()))
            names = ["shard", "lcps", "rests", "seg", "copies", "lo", "hi", "at", "wins", "wide", "back"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            a = b

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple[bytes, int]] = set()
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode()
                for x in batch.column(2)[k].as_py():
                    anchor, start, at = x["anchor"], x["start"], x["at"]
                    head = anchor.to_bytes(8, "big", signed=True) + x["a"].to_bytes(4, "big") + x["b"].to_bytes(4, "big")
                    if (head, x["seg"]) in seen:  # equal rows give equal segments
                        continue
                    seen.add((head, x["seg"]))
                    middle = start + at
                    tail = text[middle : start + x["wins"] - 1 + extent]
                    shard = (anchor ^ x["a"] * 0x9E3779B1 ^ x["b"] * 0x85EBCA77) % shards
                    held.append((shard, head + tail, x["seg"], x["copies"], x["lo"], x["hi"], at, x["wins"], x["wide"], text[start:middle][::-1]))
                    size += len(tail) + at + 100
                if size > run_bytes:
                    yield from emit(held)
                    held, size = [], 0
                    seen.clear()
        yield from emit(held)

    joined = texts.join(per_text, ["doc", "rid"], "left").where("wanted IS NOT NULL").select("doc_id", "text", "wanted")  # the columns of the last join too: one exchange of the texts serves both
    return joined.mapInArrow(run, _RUN)


class Order:
    """Segments of whole units in the sorted order of their suffixes, and in that of what lies before their anchors."""

    def __init__(self, lcp: np.ndarray, unit: np.ndarray, back: list[bytes], at: np.ndarray, wins: np.ndarray):
        """lcp: common prefix with the suffix before, 0 where a unit begins."""
        m = len(lcp)
        self.lcp, self.at, self.wins = lcp, at, wins
        order = sorted(range(m), key=lambda i: (unit[i], back[i]))
        self.reverse = np.zeros(m, dtype=np.int64)
        for k in range(1, m):
            i, j = order[k - 1], order[k]
            if unit[i] == unit[j]:
                self.reverse[k] = common_prefix(back[i], back[j], 0)
        self.order = np.array(order, dtype=np.int64)
        self.fresh = np.ones(m, dtype=bool)
        self.fresh[1:] = unit[1:] != unit[:-1]
        self.fresh_back = np.ones(m, dtype=bool)
        self.fresh_back[1:] = unit[self.order][1:] != unit[self.order][:-1]

    def repeated(self, width: int, wins: np.ndarray, alone: np.ndarray, several: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Which of the first ``wins`` windows of each segment repeat over ``width`` bytes: a matrix, segments in sorted order.

        alone: segments whose windows all do. several(members, first member of
        each class): the classes that count.
        """
        m = len(wins)
        flags = np.zeros((m, int(self.wins.max(initial=0))), dtype=bool)
        flags[alone] = True
        for o in range(int((self.at - wins + 1).min(initial=0)), int(self.at.max(initial=-1)) + 1):
            active = np.flatnonzero((self.at - wins < o) & (o <= self.at))
            if len(active) < 2:
                continue
            ahead = np.cumsum(self.fresh | (self.lcp < width - o))
            behind = np.empty(m, dtype=np.int64)
            behind[self.order] = np.cumsum(self.fresh_back | (self.reverse < o))
            key = ahead[active] * np.int64(m + 1) + behind[active]
            by = np.argsort(key, kind="stable")
            new = np.ones(len(by), dtype=bool)
            new[1:] = key[by][1:] != key[by][:-1]
            begin = np.flatnonzero(new)
            members = active[by]
            i = members[np.repeat(several(members, begin), np.diff(np.append(begin, len(by))))]
            flags[i, self.at[i] - o] = True
        flags &= np.arange(flags.shape[1]) < wins[:, None]
        return flags


def _merge_shards(width: int, shared: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("seg", "copies", "lo", "hi", "at", "wins", "wide", "back")

    def resolve(runs: list[dict]) -> Iterator[pa.RecordBatch]:
        merged = merge_runs([decode_run(r["lcps"], r["rests"]) for r in runs])
        place = [0] * len(runs)
        heads, lcps, fields = [], [], {n: [] for n in names}
        seen: set[tuple[bytes, int]] = set()
        floor = 1 << 30
        for key, h, r in merged:
            i, place[r] = place[r], place[r] + 1
            floor = min(floor, h)
            head, row = key[:_HEAD], {n: runs[r][n][i] for n in names}
            if lcps and floor < _HEAD:
                seen.clear()
            if (head, row["seg"]) in seen:
                continue
            seen.add((head, row["seg"]))
            heads.append(head)
            lcps.append(0 if floor < _HEAD else floor - _HEAD)
            floor = 1 << 30
            for n in names:
                fields[n].append(row[n])
        if not heads:
            return
        raw = np.frombuffer(b"".join(heads), dtype=">i8").reshape(-1, _HEAD // 8)
        new = np.ones(len(raw), dtype=bool)
        new[1:] = (raw[1:] != raw[:-1]).any(axis=1)
        unit = np.cumsum(new)
        lcp, at, wins, wide, copies, lo, hi = (np.array(x, dtype=np.int64) for x in (lcps, *(fields[n] for n in ("at", "wins", "wide", "copies", "lo", "hi"))))
        lcp[new] = 0
        order = Order(lcp, unit, fields["back"], at, wins)
        anchor = raw[:, 0].astype(np.int64)
        seg = np.array(fields["seg"], dtype=np.int64)
        found = (
            order.repeated(shared, wins, lo < hi, lambda who, begin: np.minimum.reduceat(lo[who], begin) < np.maximum.reduceat(hi[who], begin)),
            order.repeated(width, wide, copies > 1, lambda who, begin: np.diff(np.append(begin, len(who))) > 1),
        )
        for removed, flags in enumerate(found):
            edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            i, off = np.nonzero(edge == 1)
            _, stop = np.nonzero(edge == -1)
            columns = [pa.array(anchor[i]), pa.array(seg[i]), pa.array(off, pa.int32()), pa.array(stop - off, pa.int32()), pa.array(np.full(len(i), bool(removed)))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "off", "many", "removed"])

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, runs = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if row["shard"] != shard and runs:
                    yield from resolve(runs)
                    runs = []
                shard = row["shard"]
                runs.append(row)
        if runs:
            yield from resolve(runs)

    return run


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shared: int = SHARED, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc, rid, ``spans`` (first byte, end) of what repeated strings of ``width`` bytes cover, and ``shared``, the
    same of strings of ``shared`` bytes, no more than ``width``, that another document has; texts with neither are absent.
    """
    ship(docs.sparkSession)
    found = cut(anchors.find(docs, shared, gram, "bytes", extent=width))
    every = found.select("doc", "rid", F.inline("segments"))
    common = apart(every, ["anchor"], F.count("*").alias("n")).where("n > 1").select("anchor")
    each = cut(every.join(common, "anchor", "left_semi"))
    one = F.min(F.struct("doc", "rid", "start", "wins", "at", "wide")).alias("one")
    distinct = each.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), one)
    cost = F.col("wins") + F.lit(width - 1)
    wanted = cut(block_units(distinct.select("anchor", "seg", "copies", "lo", "hi", "one.*"), ["anchor"], F.col("seg"), cost, block_bytes).select("*", "unit.a", "unit.b").drop("unit"))
    total = wanted.agg(F.sum(cost)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    runs = _make_runs(anchors.texts(docs), wanted, width, shards, run_bytes)
    windows = runs.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merge_shards(width, shared), "anchor long, seg long, off int, many int, removed boolean")
    first = F.col("start") + F.col("off")
    hit = each.drop("wins", "at", "wide").join(windows, ["anchor", "seg"])
    size = F.when(F.col("removed"), F.lit(width)).otherwise(F.lit(shared))
    span = F.struct(first.alias("first"), (first + F.col("many") + size - 1).cast("int").alias("stop"))
    return hit.select("doc", "rid", "removed", span.alias("span")).groupBy("doc", "rid").agg(F.collect_list(F.when(F.col("removed"), F.col("span"))).alias("spans"), F.collect_list(F.when(~F.col("removed"), F.col("span"))).alias("shared"))


def _covered(spans: pa.ListArray, first: np.ndarray) -> np.ndarray:
    """Which bytes of a slice of texts, whose first bytes are given, lie in their spans."""
    step = np.zeros(first[-1] + 1, dtype=np.int32)
    flat, base = spans.flatten(), np.repeat(first[:-1], spans.value_lengths().fill_null(0).to_numpy())
    if len(flat):
        np.add.at(step, flat.field("first").to_numpy() + base, 1)
        np.add.at(step, flat.field("stop").to_numpy() + base, -1)
    return np.cumsum(step)[:-1] > 0


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_bytes: bool = False, shared: int = SHARED, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (and ``kept``, the remaining bytes) of every row of ``docs``.

    n_shared: bytes, before any are removed, in strings of ``shared`` bytes that
    another document has.
    """
    joined = anchors.texts(docs).join(repeats(docs, width, gram, shared, **sizes), ["doc", "rid"], "left").select("doc_id", "text", "spans", "shared")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept binary" * with_bytes

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(1))
            for a, b in tk.slices(offsets, 1 << 20):
                part, first = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                gone = _covered(batch.column(2).slice(a, b - a), first)
                start = gone.copy()
                start[1:] &= ~gone[:-1]
                inner = first[(first > 0) & (first < len(part))]
                start[inner] = gone[inner]
                count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
                kept, removed = part[~gone], count(gone)
                cuts = np.concatenate([[0], np.cumsum(np.diff(first) - removed)])
                texts = [kept[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(count(start), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(count(_covered(batch.column(3).slice(a, b - a), first)), pa.int64())]
                if with_bytes:
                    columns.append(pa.array(texts, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"] + ["kept"] * with_bytes)

    return joined.mapInArrow(run, schema)
