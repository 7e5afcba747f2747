"""CSV and JSON-lines export of pages or whole results."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ROW_ID


def _cell(c: SparkColumn) -> SparkColumn:
    """A CSV cell: null is empty; quoted only where it must be."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str], row_id: bool = False) -> DataFrame:
    """One ``line`` per row, without the header."""
    names = [ROW_ID] * row_id + columns
    return df.select(F.concat_ws(",", *[_cell(F.col(f"`{c}`")) for c in names]).alias("line"))


def csv_header(columns: list[str], row_id: bool = False) -> str:
    quote = lambda x: '"' + x.replace('"', '""') + '"' if re.search('[,"\r\n]', x) else x
    return ",".join(quote(x) for x in [ROW_ID] * row_id + columns)


def jsonl_lines(df: DataFrame, columns: list[str], row_id: bool = False) -> DataFrame:
    """One JSON object per row: keys sorted and once each, values as text, null as null."""
    names = sorted({*columns, *([ROW_ID] if row_id else [])})
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]), {"ignoreNullFields": "false"}).alias("line"))


def export(df: DataFrame, path: str, kind: str, columns: list[str], max_rows: int | None = None, row_id: bool = False) -> None:
    """Write a result in row-id order; max_rows is the caller's limit."""
    out = df.orderBy(ROW_ID)
    if max_rows is not None:
        out = out.limit(max_rows)
    if kind == "jsonl":
        jsonl_lines(out, columns, row_id).write.mode("errorifexists").text(path)
    else:
        names = [ROW_ID] * row_id + columns
        out.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).write.mode("errorifexists").options(header=True, nullValue="", emptyValue="", quote='"', escape='"').csv(path)


def stream(df: DataFrame, kind: str, columns: list[str], row_id: bool = False) -> Iterator[str]:
    """Lines in row-id order, a partition at a time on the driver."""
    ordered = df.orderBy(ROW_ID)
    if kind == "csv":
        yield csv_header(columns, row_id)
    lines = csv_lines(ordered, columns, row_id) if kind == "csv" else jsonl_lines(ordered, columns, row_id)
    for r in lines.toLocalIterator():
        yield r["line"]


def safe_name(text: str) -> str:
    """A file name of letters, digits, dots, dashes and underscores."""
    out = re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("._")
    return out[:120] or "export"
