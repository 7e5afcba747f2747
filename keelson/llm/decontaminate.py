"""Benchmark decontamination by an FM-index of each shard of the corpus.

A shard is a slice of whole texts. Its words become symbols of the benchmark's
vocabulary; a word outside that vocabulary can be in no phrase and only
separates, and runs shorter than the shortest phrase can hold none, so they are
not indexed. The benchmark's windows are then searched backwards through the
wavelet matrix, all in step; occurrences are located by sampled suffix
positions and merged into removal spans.

The benchmark reaches the workers in blocks of at most ``BLOCK_CHARS``
characters, one pass over the corpus for each block. All its windows pass
through the driver, which holds them until the plan is made: a benchmark is
taken to fit there (some 200 bytes for each of its words). Every block is searched in
the untouched texts; ``clean`` judges and cuts by the hits of all of them.

Defined results: a null or empty text has no words and is clean; a benchmark
item without words, without text or without an id has no windows; repeated rows
are judged one by one; an empty benchmark leaves all texts clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import textkernel as tk
from .fmindex import FMIndex
from .session import ship

WINDOW = 13
BLOCK_CHARS = 2_000_000
SLICE_BYTES = 2 << 20


@dataclass
class Phrases:
    """The distinct windows of a block of items, as right-aligned rows of vocabulary numbers."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lens: np.ndarray
    item_bounds: np.ndarray  # window i occurs in items[item_bounds[i]:item_bounds[i + 1]]
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, str]], width: int) -> Phrases:
        column = pa.array([t or "" for _, t in rows], pa.large_string())
        data, offsets = tk.text_buffer(column)
        data = tk.LOWER[data]
        ws, we, first = tk.word_spans(data, offsets, tk.ALNUM)
        vocabulary, number = np.unique(tk.hash_words(data, ws, we), return_inverse=True)
        found: dict[tuple[int, ...], dict[int, None]] = {}
        number_of = {name: i for i, name in enumerate(dict.fromkeys(n for n, _ in rows))}  # rows of one id are one item
        for i, (name, _) in enumerate(rows):
            item = number_of[name]
            words = (number[first[i] : first[i + 1]] + 1).tolist()
            size = min(width, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[k : k + size]), {})[item] = None
        windows = np.zeros((len(found), width), dtype=np.int32)
        for i, w in enumerate(found):
            windows[i, width - len(w) :] = w
        owners = list(found.values())
        bounds = np.cumsum([0, *map(len, owners)])
        flat = np.array([x for o in owners for x in o], dtype=np.int64)
        return cls(vocabulary, windows, np.array([len(w) for w in found], dtype=np.int64), bounds, flat, list(number_of))


def blocks(benchmark: DataFrame, width: int, most: int) -> Iterator[Phrases]:
    """The benchmark in blocks of whole items, in no order."""
    rows, size = [], 0
    source = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    for item, text in source.toLocalIterator():
        if rows and size + len(text) > most:
            yield Phrases.of(rows, width)
            rows, size = [], 0
        rows.append((item, text))
        size += len(text)
    yield Phrases.of(rows, width)


class Shard:
    """What a slice of texts has of a block of phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
        data = tk.LOWER[data]
        self.ws, self.we, self.first = tk.word_spans(data, offsets, tk.ALNUM)
        self.n_words = np.diff(self.first)
        n = len(self.ws)
        self.hit = np.zeros(n, dtype=bool)
        self.doc, self.item = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n or not len(phrases.windows):
            return
        symbols, word = self._runs(tk.hash_words(data, self.ws, self.we), phrases)
        if not len(symbols):
            return
        index = FMIndex(symbols, len(phrases.vocabulary) + 1)
        lo, hi = index.search(phrases.windows, phrases.lens)
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        at = word[index.locate(rows)]
        step = np.zeros(n + 1, dtype=np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + phrases.lens[which], -1)
        self.hit = np.cumsum(step[:n]) > 0
        doc = np.searchsorted(self.first, at, side="right") - 1
        pairs = np.unique(doc * len(counts) + which)
        doc, which = pairs // len(counts), pairs % len(counts)
        owners = np.diff(phrases.item_bounds)[which]
        flat = np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners) + np.repeat(phrases.item_bounds[which], owners)
        both = np.unique(np.repeat(doc, owners) * len(phrases.names) + phrases.items[flat])
        self.doc, self.item = both // len(phrases.names), both % len(phrases.names)

    def _runs(self, h: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(symbols with separators, the word of each) of the runs that can hold a phrase."""
        n = len(h)
        at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
        known = phrases.vocabulary[at] == h
        new = known.copy()
        new[1:] &= ~known[:-1]
        inner = self.first[(self.first < n) & (self.first >= 0)]
        new[inner] |= known[inner]
        last = known.copy()
        last[:-1] &= ~known[1:]
        ends = inner[inner > 0] - 1
        last[ends] |= known[ends]
        a, b = np.flatnonzero(new), np.flatnonzero(last) + 1
        long = b - a >= phrases.lens.min()
        a, b = a[long], b[long]
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = b - a + 1
        word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        symbols = np.zeros(len(word), dtype=np.int64)
        inside = np.ones(len(word), dtype=bool)
        inside[np.cumsum(size) - 1] = False
        symbols[inside] = at[word[inside]] + 1
        return symbols, word

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of hit words that stay in one text: first word, end, and the first run of each text."""
        n = len(self.hit)
        new, last = self.hit.copy(), self.hit.copy()
        new[1:] &= ~self.hit[:-1]
        last[:-1] &= ~self.hit[1:]
        inner = self.first[self.first < n]
        new[inner] |= self.hit[inner]
        ends = inner[inner > 0] - 1
        last[ends] |= self.hit[ends]
        a, b = np.flatnonzero(new), np.flatnonzero(last) + 1
        return a, b, np.searchsorted(a, self.first)

    def column(self) -> pa.ListArray:
        """The spans of each text, counted in its own words."""
        first, stop, bounds = self.spans()
        base = np.repeat(self.first[:-1], np.diff(bounds))
        spans = pa.StructArray.from_arrays([pa.array(first - base, pa.int32()), pa.array(stop - base, pa.int32())], names=["first", "stop"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)

    def add(self, spans: pa.ListArray) -> None:
        """Words in the spans of another block of phrases are hits too."""
        bounds = spans.offsets.to_numpy()
        first, stop = (x.to_numpy() for x in spans.values.slice(bounds[0], bounds[-1] - bounds[0]).flatten())
        base = np.repeat(self.first[:-1], np.diff(bounds))
        step = np.zeros(len(self.hit) + 1, dtype=np.int64)
        np.add.at(step, first + base, 1)
        np.add.at(step, stop + base, -1)
        self.hit |= np.cumsum(step[:-1]) > 0


_SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("stop", IntegerType())]))
_SCHEMA = "doc_id long, rid long, n_words long, spans array<struct<first:int,stop:int>>, items array<string>"


def _scan(docs: DataFrame, phrases: Phrases) -> DataFrame:
    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(phrases.names, dtype=object)
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(2))
            for a, b in tk.slices(offsets, SLICE_BYTES):
                shard = Shard(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], phrases)
                columns = [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array(shard.n_words, pa.int64()),
                    shard.column(),
                    tk.lists(names[shard.item], np.searchsorted(shard.doc, np.arange(b - a + 1)), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "n_words", "spans", "items"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, _SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, spans (of words, merged) and items of every row of ``docs``."""
    ship(docs.sparkSession)
    parts = [_scan(docs, p) for p in blocks(benchmark, width, block_chars)]
    if len(parts) == 1:
        out = parts[0].drop("rid")
    else:
        every = parts[0].withColumn("copy", F.lit(1))
        for p in parts[1:]:
            every = every.unionByName(p.withColumn("copy", F.lit(0)))
        grouped = every.groupBy("doc_id", "rid").agg(
            F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.sum("copy").cast("int").alias("copies")
        )
        merged = F.aggregate("spans", F.array().cast("array<struct<first:int,stop:int>>"), _merge)
        out = grouped.withColumn("spans", merged).select("doc_id", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    return out.withColumn("items", F.array_sort("items"))


def _merge(acc: Column, x: Column) -> Column:
    last = F.try_element_at(acc, F.lit(-1))
    whole = F.struct(last["first"].alias("first"), F.greatest(last["stop"], x["stop"]).alias("stop"))
    return F.when(x["first"] <= last["stop"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(whole))).otherwise(F.concat(acc, F.array(x)))


def digest(found: DataFrame) -> DataFrame:
    """The per-document figures of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn(
        "contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without contaminated rows; what other rows share with the benchmark is cut out of their texts.

    All columns pass through; only ``text`` can change.
    """
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    carried = "_hits"
    while carried in docs.columns:
        carried += "_"
    marked = StructType([*docs.schema.fields, StructField(carried, _SPANS)])
    every = list(blocks(benchmark, width, block_chars))
    out = docs
    for phrases in every[:-1]:
        out = out.mapInArrow(_marker(phrases, at, len(docs.columns), carried), marked)
    return out.mapInArrow(_cleaner(every[-1], at, len(docs.columns)), docs.schema)


def _marked(batch: pa.RecordBatch, phrases: Phrases, at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Shard]]:
    """Slices of a batch of ``width`` columns with the hits of a block; a further column has the spans of earlier blocks."""
    data, offsets = tk.text_buffer(batch.column(at))
    for a, b in tk.slices(offsets, SLICE_BYTES):
        part, local, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch.slice(a, b - a)
        shard = Shard(part, local, phrases)
        if batch.num_columns > width:
            shard.add(rows.column(width))
            rows = rows.select(list(range(width)))
        yield rows, part, local, shard


def _marker(phrases: Phrases, at: int, width: int, name: str):
    """The rows as they are, with the spans of this block and of earlier ones in a last column."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _, shard in _marked(batch, phrases, at, width):
                yield pa.RecordBatch.from_arrays([*rows.columns, shard.column()], names=[*rows.schema.names, name])

    return run


def _cleaner(phrases: Phrases, at: int, width: int):
    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part, local, shard in _marked(batch, phrases, at, width):
                first, stop, bounds = shard.spans()
                per = np.add.reduceat(np.append(shard.hit, False).astype(np.int64), shard.first[:-1]) * (shard.n_words > 0) if len(shard.hit) else shard.n_words
                bad = (per > 0) & (20 * per >= shard.n_words)
                touched = np.flatnonzero((per > 0) & ~bad)
                if len(touched):
                    texts = rows.column(at).to_pylist()
                    for d in touched:
                        kept, last = [], local[d]
                        for k in range(bounds[d], bounds[d + 1]):
                            kept.append(part[last : shard.ws[first[k]]])
                            last = shard.we[stop[k] - 1]
                        kept.append(part[last : local[d + 1]])
                        texts[d] = np.concatenate(kept).tobytes().decode()
                    rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
                yield rows.filter(pa.array(~bad))

    return run
