"""Substring dedup by a compressed FM-index per shard.

Texts are cut into anchored segments (see ``anchors``); only segments whose
anchor occurs in two documents can hold a repeated window. Equal segments are
collapsed to one with its least document before anything is indexed, so a
passage in a third of all documents costs one indexed copy. Each shard of
anchors gets an FM-index; its segments are streamed through it, and backward
search over the wavelet matrix gives matching statistics. Every window whose
match reaches the threshold takes the least document among the rows that agree
with it.

Defined results: a null or empty text has no words; a row without doc_id is
compared with nothing; equal rows, and rows with one doc_id, don't count as
another document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import textkernel as tk
from .fmindex import FMIndex
from .grouping import apart, batches_of_groups, block_units
from .session import cut, ship

WINDOW, GRAM = 50, 12
SHARD_WORDS, BLOCK_WORDS = 400_000, 2_000_000


def shared_segments(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """One row for every segment whose anchor occurs in at least two documents."""
    found = cut(anchors.find(docs.where("doc_id IS NOT NULL"), width, gram, "words"))
    each = found.select("doc", "rid", F.inline("segments")).drop("at", "wide")
    common = apart(each, ["anchor"], F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    return cut(each.join(common, "anchor", "left_semi"))


def _fetch(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The words of one occurrence of every distinct segment, once for each of its units."""
    per_text = wanted.groupBy("doc", "rid").agg(F.collect_list(F.struct("anchor", "seg", "lo", "a", "b", "start", "wins")).alias("wanted"))

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(1))
            for a, b in tk.slices(offsets, 1 << 20):
                part = data[offsets[a] : offsets[b]]
                ws, we, first = tk.word_spans(part, offsets[a : b + 1] - offsets[a], tk.NOT_SPACE)
                rows = batch.column(2).slice(a, b - a)
                flat = rows.flatten()
                owner = np.repeat(first[:-1], rows.value_lengths().fill_null(0).to_numpy())
                start = flat.field("start").to_numpy() + owner
                size = flat.field("wins").to_numpy() + width - 1
                lo, hi = ws[start], we[start + size - 1]
                text = pa.array([part[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                columns = [flat.field(n) for n in ("anchor", "seg", "lo", "a", "b", "wins")] + [pa.array(size, pa.int32()), text]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "lo", "a", "b", "wins", "words", "text"])

    joined = texts.join(per_text, ["doc", "rid"], "left").where("wanted IS NOT NULL").select("doc_id", "text", "wanted")  # the columns of the last join too: one exchange of the texts serves both
    return joined.mapInArrow(run, "anchor long, seg long, lo long, a int, b int, wins int, words int, text binary")


def _windows(width: int, shard_words: int):
    """Matching statistics of a shard's segments in its own index: runs of windows with the least document of each."""

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of_groups(batches, ["anchor", "a", "b"], "words", shard_words):
            table = table.combine_chunks()
            column = table.column("text").chunk(0)
            data, offsets = tk.text_buffer(column)
            ws, we, first = tk.word_spans(data, offsets, tk.NOT_SPACE)
            h = tk.hash_words(data, ws, we)
            vocabulary, number = np.unique(h, return_inverse=True)
            m, n = len(first) - 1, len(h)
            # sequences of symbols, each with its separator
            seq = np.repeat(np.arange(m), np.diff(first))
            symbols = np.zeros(n + m, dtype=np.int64)
            place = np.arange(n) + seq
            symbols[place] = number + 1
            # the least document of the rows that agree in a whole window
            owner = np.append(np.repeat(table.column("lo").to_numpy(), np.diff(first) + 1), np.iinfo(np.int64).max)[: len(symbols)]
            index = FMIndex(symbols, len(vocabulary) + 1, cap=width, values=owner)
            starts = first[:-1] + np.arange(m)
            size, row = index.matching_statistics(symbols, starts, starts + np.diff(first))
            wins = table.column("wins").to_numpy().astype(np.int64)
            which = np.repeat(np.arange(m), wins)
            off = np.arange(len(which)) - np.repeat(np.cumsum(wins) - wins, wins)
            at = first[which] + off
            low = np.where(size[at] >= width, index.least[index.class_of[row[at]]], np.iinfo(np.int64).max)
            new = np.ones(len(which), dtype=bool)
            new[1:] = (which[1:] != which[:-1]) | (low[1:] != low[:-1])
            i = np.flatnonzero(new)
            many = np.diff(np.append(i, len(which)))
            real = low[i] < np.iinfo(np.int64).max
            i, many = i[real], many[real]
            picked = table.select(["anchor", "seg"]).take(pa.array(which[i])).combine_chunks()
            columns = [picked.column(0).chunk(0) if len(i) else pa.array([], pa.int64()), picked.column(1).chunk(0) if len(i) else pa.array([], pa.int64()), pa.array(off[i], pa.int32()), pa.array(many, pa.int32()), pa.array(low[i], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "off", "many", "least"])

    return run


def repeats(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc, rid and ``spans`` (first word, end) of what windows in smaller documents cover; texts without any are absent."""
    ship(docs.sparkSession)
    each = shared_segments(docs, width, gram)
    distinct = each.groupBy("anchor", "seg").agg(F.min("doc").alias("lo"), F.min(F.struct("doc", "rid", "start", "wins")).alias("one"))
    wanted = block_units(distinct.select("anchor", "seg", "lo", "one.*"), ["anchor"], F.col("seg"), F.col("wins") + F.lit(width - 1), block_words)
    units = _fetch(anchors.texts(docs), wanted.select("*", "unit.a", "unit.b"), width)
    sharded = units.repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")
    least = sharded.mapInArrow(_windows(width, shard_words), "anchor long, seg long, off int, many int, least long")
    hit = each.join(least, ["anchor", "seg"]).where("least < doc")
    first = F.col("start") + F.col("off")
    return hit.select("doc", "rid", F.struct(first.alias("first"), (first + F.col("many") + F.lit(width - 1)).cast("int").alias("stop")).alias("span")).groupBy("doc", "rid").agg(F.collect_list("span").alias("spans"))


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``, the words joined by one space) of every row of ``docs``."""
    joined = anchors.texts(docs).join(repeats(docs, width, gram), ["doc", "rid"], "left").select("doc_id", "text", "spans")

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(1))
            for a, b in tk.slices(offsets, 1 << 20):
                part = data[offsets[a] : offsets[b]]
                ws, we, first = tk.word_spans(part, offsets[a : b + 1] - offsets[a], tk.NOT_SPACE)
                rows = batch.column(2).slice(a, b - a)
                flat, base = rows.flatten(), np.repeat(first[:-1], rows.value_lengths().fill_null(0).to_numpy())
                step = np.zeros(len(ws) + 1, dtype=np.int64)
                if len(flat):
                    np.add.at(step, flat.field("first").to_numpy() + base, 1)
                    np.add.at(step, flat.field("stop").to_numpy() + base, -1)
                gone = np.cumsum(step)[: len(ws)] > 0
                texts = joined_words(part, ws, we, ~gone, first)
                n = np.diff(first)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return joined.mapInArrow(run, _KEPT + ", kept string" * with_text)


def joined_words(data: np.ndarray, ws: np.ndarray, we: np.ndarray, keep: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The kept words of every text, joined by one space."""
    a, b = ws[keep], we[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[first]
    size = b - a + 1
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(a, size)
    out = np.append(data, np.uint8(0x20))[np.minimum(at, len(data))]
    if len(ends):
        out[ends - 1] = 0x20
    cuts = np.concatenate([[0], ends])[bounds]
    return [out[x : max(x, y - 1)].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
