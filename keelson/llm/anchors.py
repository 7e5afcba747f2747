"""Content-defined anchors: where repeated windows of a fixed width must meet.

A window of ``width`` items (words or bytes) has one anchor, the least of its
hashed grams. Equal windows have equal anchors at equal offsets, so two equal
windows always lie in *segments* (maximal runs of windows with one anchor)
that carry the same anchor hash. Grouping segments by anchor is therefore
exact, whatever the data, and moves about two segments per ``width`` items
instead of every window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .session import ship

#: A fixed random value for each byte.
_BYTE = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOUND = "doc long, rid long, segments array<struct<anchor:long,seg:long,start:int,wins:int,at:int,wide:int>>"


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the two columns that stand for a row in joins.

    ``doc`` is the doc_id with a value in place of null; ``rid`` tells rows of
    one doc_id with different texts apart (equal rows have equal results).
    """
    doc_id = docs["doc_id"].cast("long")
    doc = F.coalesce(doc_id, F.lit(-(2**63)))
    return docs.select(doc_id.alias("doc_id"), doc.alias("doc"), F.xxhash64(docs["doc_id"], docs["text"]).alias("rid"), docs["text"].cast("string").alias("text"))


def _segments(values: np.ndarray, gram: np.ndarray, bounds: np.ndarray, width: int, k: int, extent: int) -> tuple[np.ndarray, ...]:
    """(starts, windows, anchor hashes, segment hashes, anchor offsets, windows with room for ``extent`` items, first segment of each text)."""
    n = len(values)
    none = np.zeros(0, np.int64)
    p = tk.window_argmin(gram, width - k + 1)  # for windows 0 .. n - width
    if not len(p):
        return none, none, none, none, none, none, np.zeros(len(bounds), np.int64)
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, bounds[:-1], 1)
    np.add.at(step, np.maximum(bounds[1:] - width + 1, bounds[:-1]), -1)
    valid = np.cumsum(step)[: len(p)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (p[1:] != p[:-1])
    starts = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (p[1:] != p[:-1])
    ends = np.flatnonzero(last) + 1
    at = p[starts]
    first = np.searchsorted(starts, bounds)
    text_end = np.repeat(bounds[1:], np.diff(first))
    content = tk.RangeHash(values).of(starts, np.minimum(ends - 1 + extent, text_end))
    wide = np.clip(text_end - extent - starts + 1, 0, ends - starts)
    return starts, ends - starts, gram[at], content, at - starts, wide, first


def word_segments(data: np.ndarray, offsets: np.ndarray, width: int, k: int, extent: int) -> tuple[np.ndarray, ...]:
    """Segments over the words between white space, and each text's first word."""
    ws, we, bounds = tk.word_spans(data, offsets, tk.NOT_SPACE)
    h = tk.hash_words(data, ws, we)
    return *_segments(h, tk.grams(h, k), bounds, width, k, extent), bounds


def byte_segments(data: np.ndarray, offsets: np.ndarray, width: int, k: int, extent: int) -> tuple[np.ndarray, ...]:
    """Segments over bytes, and each text's first byte."""
    return *_segments(_BYTE[data], tk.byte_grams(data, k), offsets, width, k, extent), offsets


def find(docs: DataFrame, width: int, k: int, unit: str, slice_bytes: int = 1 << 19, extent: int = 0) -> DataFrame:
    """doc, rid and the segments of each text that has any.

    extent: what is compared from a window's start on, where the text has it
    (at least the window). A segment's content, and with it its hash, goes as
    far; ``wide`` is the number of its windows that have it in full.
    """
    ship(docs.sparkSession)
    extent = max(extent, width)
    of = word_segments if unit == "words" else byte_segments

    @tk.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_buffer(batch.column(2))
            for a, b in tk.slices(offsets, slice_bytes):
                part = data[offsets[a] : offsets[b]]
                starts, wins, anchor, seg, at, wide, first, base = of(part, offsets[a : b + 1] - offsets[a], width, k, extent)
                has = np.flatnonzero(np.diff(first))
                if not len(has):
                    continue
                # positions are counted from the text's first item
                local = starts - np.repeat(base[:-1], np.diff(first))
                bounds = np.append(first[has], first[-1])
                fields = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(local, pa.int32()), pa.array(wins, pa.int32()), pa.array(at, pa.int32()), pa.array(wide, pa.int32())]
                rows = pa.StructArray.from_arrays(fields, names=["anchor", "seg", "start", "wins", "at", "wide"])
                picked = batch.slice(a, b - a).take(pa.array(has))
                out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), out], names=["doc", "rid", "segments"])

    return texts(docs).select("doc", "rid", "text").mapInArrow(run, _FOUND)

