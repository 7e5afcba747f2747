"""Parquet shards queried in place: global row ids, raw text comparison, exact cursors.

Filters on an attached bucket compare text as it is (no normalisation); a range
may be on any column and is lexicographic.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest
from ..plans.shared import lookup
from ..plans.request import MAX_LIMIT, Eq, In, Range, Request
from ..schema import ROW_ID

MAX_FILTERS, MAX_VALUES = 32, 1024


def shard_offsets(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(file, first id, rows) in name order; counts come from Parquet footers."""
    rows = spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    out, first = [], 0
    for r in sorted(rows, key=lambda r: r["f"]):
        out.append((r["f"], first, r["count"]))
        first += r["count"]
    return out


def frame(spark: SparkSession, paths: list[str], offsets: list[tuple[str, int, int]] | None = None, after: int | None = None) -> DataFrame:
    """All rows with their global ids: the shard's offset plus the row's number in it.

    offsets: as ``shard_offsets`` has them, if they are known. after: shards
    whose ids all come before it are not read.
    """
    offsets = shard_offsets(spark, paths) if offsets is None else offsets
    wanted = [(f, first) for f, first, n in offsets if after is None or first + n - 1 > after]
    source = spark.read.parquet(*paths) if len(wanted) == len(offsets) or not wanted else spark.read.parquet(*[unquote(f) for f, _ in wanted])
    rows = source.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    joined = rows.join(lookup(spark, wanted, "_f string, _first bigint"), "_f")
    return joined.withColumn(ROW_ID, F.col("_first") + F.col("_i")).drop("_f", "_i", "_first")


class Attached:
    """A read-only bucket over Parquet files that stay where they are."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, sorted(paths)
        self.offsets = shard_offsets(spark, self.paths)
        self.types = {f.name: f.dataType for f in spark.read.parquet(*self.paths).schema}
        self.columns = list(self.types)

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.offsets)

    def _among(self, column: str, values: list[str]):
        """Rows whose text is one of the values. Of integers and booleans each value has one text, so typed values can reach the scan."""
        kind, c = self.types[column], F.col(f"`{column}`")
        if isinstance(kind, T.IntegralType):
            bits = 8 * {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}[kind.simpleString()]
            numbers = [int(v) for v in values if re.fullmatch("0|-?[1-9][0-9]*", v)]
            typed = [F.lit(v).cast(kind) for v in numbers if -(1 << bits - 1) <= v < 1 << bits - 1]
        elif isinstance(kind, T.BooleanType):
            typed = [F.lit(v == "true") for v in values if v in ("true", "false")]
        else:
            c, typed = c.cast("string"), values
        return c.isin(typed) if typed else F.lit(False)

    def _predicate(self, f):
        if f.column not in self.columns:
            raise InvalidRequest(f"unknown column {f.column}")
        c = F.col(f"`{f.column}`").cast("string")
        if isinstance(f, Eq):
            return c.isNull() if f.value is None else self._among(f.column, [f.value])
        if isinstance(f, In):
            if not f.values or len(f.values) > MAX_VALUES:
                raise InvalidRequest(f"IN takes 1 to {MAX_VALUES} values")
            some = self._among(f.column, [v for v in f.values if v is not None])
            return some | c.isNull() if None in f.values else some
        if isinstance(f, Range):
            if f.gte is None and f.lte is None:
                raise InvalidRequest("a range needs a bound")
            out = F.lit(True)
            if f.gte is not None:
                out = out & (c >= f.gte)
            return out & (c <= f.lte) if f.lte is not None else out
        raise InvalidRequest("unknown filter")

    def page(self, request: Request) -> DataFrame:
        if len(request.filters) > MAX_FILTERS or not 1 <= request.limit <= MAX_LIMIT:
            raise InvalidRequest(f"at most {MAX_FILTERS} filters and {MAX_LIMIT} rows")
        df = frame(self.spark, self.paths, self.offsets, request.after_row_id)
        for f in request.filters:
            df = df.where(self._predicate(f))
        if request.after_row_id is not None:
            df = df.where(F.col(ROW_ID) > request.after_row_id)
        for c in request.select:
            if c not in self.columns:
                raise InvalidRequest(f"unknown column {c}")
        names = list(dict.fromkeys(request.select)) or self.columns
        return df.select(ROW_ID, *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).orderBy(ROW_ID)

    def query(self, request: Request) -> tuple[list, int | None]:
        """(rows, next cursor); the cursor is exact, from one row more than asked for."""
        rows = self.page(request).limit(request.limit + 1).collect()
        more = len(rows) > request.limit
        rows = rows[: request.limit]
        return rows, rows[-1][ROW_ID] if more else None

    def row(self, row_id: int):
        """One row by id: arithmetic finds its shard, and only that shard is read."""
        for path, first, n in self.offsets:
            if first <= row_id < first + n:
                df = self.spark.read.parquet(path).where(F.col("_metadata.row_index") == row_id - first)
                found = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in self.columns]).collect()
                return found[0].asDict() if found else None
        return None
