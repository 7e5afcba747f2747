"""SHA-256 of many files, each streamed through one task on the executors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

BLOCK_BYTES = 8 << 20
#: Up to so many bytes and files are hashed by the driver itself.
DRIVER_BYTES, DRIVER_FILES = 32 << 20, 64


def _mounted(spark: SparkSession, store: Store, paths: list[str], base: str) -> DataFrame:
    """Files of a file system that every executor has mounted."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with open(path, "rb") as f:
                    while block := f.read(BLOCK_BYTES):
                        digest.update(block)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string())], names=["file", "sha256"])

    rows = spark.createDataFrame([(f"{base}/{p}", p) for p in paths], "path string, file string")
    return rows.repartition(min(len(paths), 8 * spark.sparkContext.defaultParallelism)).mapInArrow(streamed, "file string, sha256 string")


def _remote(spark: SparkSession, store: Store, paths: list[str], base: str) -> DataFrame:
    """Files that only Spark's readers can open: whole values, so files must stay below 2 GB."""
    read = spark.read.format("binaryFile").load([store.at(p) for p in paths])
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return read.select(F.substring(plain, len(base) + 2, 1 << 20).alias("file"), F.sha2("content", 256).alias("sha256"))


def digests(spark: SparkSession, store: Store, sizes: dict[str, int]) -> dict[str, str]:
    """Digest by path, for files with their sizes; fails if one is missing. A few small files aren't worth a job."""
    paths = sorted(sizes)
    if sum(sizes.values()) <= DRIVER_BYTES and len(paths) <= DRIVER_FILES:
        return {p: store.sha256(p) for p in paths}
    uri = store.qualified()
    base = unquote(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", uri)).rstrip("/")
    how = _mounted if uri.startswith("file:") else _remote
    found = {r["file"]: r["sha256"] for r in how(spark, store, paths, base).collect()}
    if set(found) != set(paths):
        raise FileNotFoundError(f"{sorted(set(paths) - set(found))[:5]}")
    return found
