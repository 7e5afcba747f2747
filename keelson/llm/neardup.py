"""Near-duplicates by SetSketch registers.

A document's set is its distinct word shingles, as 64-bit hashes. A register
holds the exponentially spaced, truncated minimum of one hash function over the
set; equal registers are about as likely as the Jaccard similarity, and
registers of parts merge by maximum. Bands of ``ROWS`` registers find
candidates; the joint likelihood of two sketches, given both set sizes, rules
out clearly different ones; the rest is verified on the full sets.

Equal sets are one class from the start. A bucket of classes with one band is
verified in blocks of bounded size, every two blocks of a bucket in one work
unit, and inside a unit a pair that is already connected is not looked at
again. Buckets with the same members as another are verified once. The number
of bands follows from the threshold: a pair at the threshold is missed with a
probability below ``MISS``.

Defined results: a null or empty text has no shingles and is linked with
nothing; rows with one doc_id count as one document; a row without doc_id is
linked with nothing, has no component and is kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import textkernel as tk
from .components import components
from .grouping import batches_of_groups, block_units
from .session import cut, release, ship

ROWS, MISS = 4, 1e-7
BASE, RATE, TOP = 1.001, 20.0, 65535
BLOCK_SHINGLES, BATCH_SHINGLES = 1_000_000, 500_000
SLICE_BYTES = 1 << 20


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of every text. A text of fewer than k words has one, of all its words."""
    data = tk.LOWER[data]
    ws, we, first = tk.word_spans(data, offsets, tk.NOT_SPACE)
    h = tk.hash_words(data, ws, we)
    g = tk.grams(h, k)
    sets, sizes = [], np.zeros(len(first) - 1, dtype=np.int64)
    at = first.tolist()
    for i in range(len(sizes)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            keep = np.ones(len(x), dtype=bool)
            keep[1:] = x[1:] != x[:-1]
            x = x[keep]
        elif b > a:
            x = tk.grams(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        sets.append(x)
        sizes[i] = len(x)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def registers(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """SetSketch registers of every non-empty set, one row each."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), count), dtype=np.uint16)
    if not len(starts):
        return out
    seeds = tk.mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    work = np.empty_like(hashes)
    for i in range(count):
        np.bitwise_xor(hashes, seeds[2 * i], out=work)
        np.multiply(work, seeds[2 * i + 1] | np.uint64(1), out=work)
        u = (np.minimum.reduceat(work, starts).astype(np.float64) + 0.5) / 2.0**64
        least = -np.log1p(-u) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, TOP)
    return out


def similarity(x: np.ndarray, ys: np.ndarray, nx: int, ny: np.ndarray) -> np.ndarray:
    """The similarity of one sketch to others that their registers make likeliest, given the set sizes."""
    more = (x > ys).sum(axis=1)
    less = (x < ys).sum(axis=1)
    same, m = len(x) - more - less, len(x)
    u = nx / (nx + ny)
    v = 1 - u
    b = v * v * (same + more) + u * u * (same + less)
    return (b - np.sqrt(np.maximum(b * b - 4 * u * u * v * v * m * same, 0))) / (2 * u * v * m)


def _sketch(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, doc, rid, n_shingles, cls (digest of the set) and band keys of every row."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(3))
            for a, b in tk.slices(offsets, SLICE_BYTES):
                h, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sizes = np.diff(bounds)
                full = sizes > 0
                keys = registers(h, bounds, bands * ROWS).view("<i8")  # the registers of a band as one number
                digests = [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                at = np.concatenate([[0], np.cumsum(full * bands)])
                columns = [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), tk.lists(keys.reshape(-1), at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "doc", "rid", "n_shingles", "cls", "bands"])

    source = anchors.texts(docs).select("doc_id", "doc", "rid", "text")
    return source.mapInArrow(run, "doc_id long, doc long, rid long, n_shingles long, cls binary, bands array<long>")


def _sets(texts: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """node, cls, bands and the full set of every class in ``reps``."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(0))
            for a, b in tk.slices(offsets, SLICE_BYTES):
                h, bounds = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sets = pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(1, 4)), sets], names=["node", "cls", "bands", "set"])

    joined = texts.join(reps.withColumn("node", F.col("doc")), ["doc", "rid"], "left").where("cls IS NOT NULL").select("text", "node", "cls", "bands")
    return joined.mapInArrow(run, "node long, cls binary, bands array<long>, set binary")


def _verify(percent: int, floor: float):
    """Links inside every work unit: (u, v), v the least member connected with u there."""

    def links(nodes, sizes, regs, sets, cross) -> list[tuple[int, int]]:
        m = len(nodes)
        root = np.arange(m)
        flat = np.concatenate(sets)
        values, ids = np.unique(flat, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        flag = np.zeros(len(values), dtype=bool)
        for i in range(m - 1):
            rest = np.arange(i + 1, m)
            ok = root[rest] != root[i]
            if cross is not None:
                ok &= cross[rest] != cross[i]
            few, many = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
            ok &= 100 * few >= percent * many
            rest = rest[ok]
            if len(rest):
                rest = rest[similarity(regs[i], regs[rest], sizes[i], sizes[rest]) >= floor]
            if not len(rest):
                continue
            own = ids[starts[i] : starts[i] + sizes[i]]
            flag[own] = True
            if len(rest) == 1:
                j = rest[0]
                both = np.array([np.count_nonzero(flag[ids[starts[j] : starts[j] + sizes[j]]])])
            else:
                at = np.repeat(starts[rest] - (np.cumsum(sizes[rest]) - sizes[rest]), sizes[rest]) + np.arange(sizes[rest].sum())
                both = np.add.reduceat(flag[ids[at]].astype(np.int32), np.cumsum(sizes[rest]) - sizes[rest])
            flag[own] = False
            union = sizes[i] + sizes[rest] - both
            linked = rest[100 * both >= percent * union]
            if len(linked):
                joined = np.unique(np.append(root[linked], root[i]))
                root[np.isin(root, joined)] = joined[0]
        out = []
        for r in np.flatnonzero(np.bincount(root, minlength=m) > 1):
            members = nodes[root == r]
            least = int(members.min())
            out += [(int(x), least) for x in members if x != least]
        return out

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of_groups(batches, ["key", "a", "b"], "n", BATCH_SHINGLES):
            table = table.combine_chunks()
            n = table.num_rows
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")])
            new = np.ones(n, dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            cuts = np.append(np.flatnonzero(new), n).tolist()
            nodes, own = table.column("node").to_numpy(), table.column("own").to_numpy()
            sizes = table.column("n").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("set").chunk(0)]
            bands = table.column("bands").chunk(0)
            regs = bands.flatten().to_numpy().reshape(n, -1).view(np.uint16)
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1:
                    cross = own[x:y] if keys[1, x] != keys[2, x] else None
                    found += links(nodes[x:y], sizes[x:y], regs[x:y], sets[x:y], cross)
            pairs = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, words: int, percent: int, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, doc, rid, n_shingles, component_id and kept of every row of ``docs``.

    words: of a shingle. percent: least similarity of a link, in hundredths.
    """
    ship(docs.sparkSession)
    bands = bands_for(percent / 100)
    rows = cut(_sketch(docs, words, bands))
    classes = cut(
        rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("cls")
        .agg(F.min(F.struct("doc", "rid")).alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .select("cls", "one.*", "n", "bands")
    )
    # a bucket is a band and its registers, hashed to one number: a collision only adds candidates
    banded = classes.select("cls", "n", F.posexplode("bands").alias("band", "regs")).select("cls", "n", F.xxhash64("band", "regs").alias("key"))
    member = F.xxhash64("cls")
    buckets = banded.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(member).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")).where("c > 1")
    once = buckets.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = cut(banded.join(once, "key"))
    units = block_units(members, ["key"], member, F.col("n"), block_shingles).select("cls", "n", "key", "unit.*")
    reps = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "doc", "rid", "bands")
    sets = _sets(anchors.texts(docs), reps, words)
    dealt = units.join(sets, "cls").select("key", "a", "b", "own", "n", "node", "bands", "set")
    floor = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / (bands * ROWS))
    links = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_verify(percent, floor), "u long, v long")
    found = components(links)
    del banded, buckets, once, members, units, reps, sets, dealt, links
    release(docs.sparkSession)
    of = classes.select("cls", F.col("doc").alias("node")).join(found, "node", "left").select("cls", F.coalesce("component", "node").alias("component"))
    joined = rows.join(of, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "doc", "rid", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, its least doc_id.

    Rows with equal doc_id and text count once; where they differ in other
    columns, any one of them stays.
    """
    names = docs.columns
    verdict = near_duplicates(docs, words, percent).where("kept").select(F.col("doc").alias("_keelson_doc"), F.col("rid").alias("_keelson_rid")).distinct()
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    keyed = docs.withColumns({"_keelson_doc": doc, "_keelson_rid": F.xxhash64(docs["doc_id"], docs["text"])})
    return keyed.join(verdict, ["_keelson_doc", "_keelson_rid"], "left_semi").dropDuplicates(["_keelson_doc", "_keelson_rid"]).select(*names)
