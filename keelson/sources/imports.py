"""Imports: external files become a new generation, or a delta layer of the current one."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConflictError, InvalidData, NotFound
from ..operators.catalog import Catalog, Layer, Manifest, Staging
from ..operators.versioned import LAYER
from ..schema import ROW_ID, Schema, union
from . import rows as R


@dataclass
class Report:
    generation: int
    source_rows: int
    accepted_rows: int
    rejected_rows: int
    resumed: bool = False


def _manifest(staging: Staging, schema: Schema, path: str, n: int, accelerators: list[list[str]], hot: list[str], source: str) -> Manifest:
    raw = json.loads(schema.to_json())
    for columns in accelerators:
        check_accelerator(schema, columns)
    sets = sorted({tuple(sorted(x)) for x in accelerators})
    copies = {"+".join(x): {path: staging.clustered(path, list(x))} for x in sets}
    return Manifest(0, raw, [Layer(0, path, n, raw)], None, n, n - 1, [list(x) for x in sets], hot, source=source, copies=copies)


def check_accelerator(schema: Schema, columns: list[str]) -> None:
    if len(columns) < 2 or len(set(columns)) != len(columns):
        raise InvalidData("an accelerator needs at least two different columns")
    for c in columns:
        schema[c]


def _strict(checked: DataFrame, schema: Schema) -> tuple[int, Schema]:
    """(rows, schema widened for short rows); the first bad value fails everything. One pass."""
    widened = [F.max(F.col(R.SHORT) & F.col(f"`{c.name}`").isNull()).alias(f"w{i}") for i, c in enumerate(schema.columns)]
    r = checked.agg(F.count("*").alias("n"), F.min(R.ERROR).alias("bad"), *widened).first()
    if r["bad"] is not None:
        raise InvalidData(r["bad"])
    if not r["n"]:
        raise InvalidData("the source has no rows")
    return r["n"], schema.widened(c.name for i, c in enumerate(schema.columns) if r[f"w{i}"])


def import_csv(catalog: Catalog, path: str, schema: Schema, accelerators: list[list[str]] | None = None, initial: bool = False, multiline: bool | None = None) -> Report:
    """Strict CSV as a new generation that replaces the current one. initial: refuse a populated dataset."""
    with catalog.begin(empty=initial) as staging:
        raw = R.checked(R.strict_csv(catalog.spark, path, schema, multiline), schema, True)
        n, schema = _strict(raw, schema)
        out = staging.write(R.positioned(R.stored(raw, schema, True), 0, ROW_ID))
        staging.publish(_manifest(staging, schema, out, n, accelerators or [], [], f"csv:{path}"))
    return Report(catalog.current(), n, n, 0)


def import_segmented(catalog: Catalog, path: str, schema: Schema, rows_per_part: int = 1_000_000, append: bool = False, multiline: bool | None = None, bytes_per_part: int | None = None) -> Report:
    """Strict CSV in parts of so many rows, published at once: the first is the base, the others delta layers.

    bytes_per_part: also at most about so many bytes of the source in a part, by its average row.

    append: all parts become delta layers of the current generation, and ids go on from its highest.
    """
    with catalog.begin(empty=not append) as staging:
        base = staging.base
        if append and base is None:
            raise NotFound("no dataset to append to")
        raw = R.checked(R.strict_csv(catalog.spark, path, schema, multiline), schema, True)
        n, schema = _strict(raw, schema)
        if bytes_per_part is not None:
            rows_per_part = max(1, min(rows_per_part, n * bytes_per_part // max(1, source_bytes(catalog, path))))
        first = base.max_row_id + 1 if append else 0
        ids = R.positioned(R.stored(raw, schema, True), first, ROW_ID)
        start = max(x.number for x in base.layers) + 1 if append else 0
        parts = -(-n // rows_per_part)
        if parts > 1:  # one folder for all: files, plans and jobs follow the rows, not the parts
            number = F.expr(f"CAST((`{ROW_ID}` - {first}L) DIV {rows_per_part}L + {start} AS INT)")
            ids = ids.withColumn(LAYER, number)
        whole = staging.write(ids)
        known = json.loads(schema.to_json())
        new = [Layer(start + k, whole, min(rows_per_part, n - k * rows_per_part), known) for k in range(parts)]
        if append:
            merged = _merged(base, schema)
            staging.publish(_grown(base, merged, new, n, f"append:{path}"))
        else:
            staging.publish(Manifest(0, known, new, None, n, n - 1, source=f"csv:{path}"))
    return Report(catalog.current(), n, n, 0)


def _merged(base: Manifest, schema: Schema) -> Schema:
    old = Schema.from_json(base.schema)
    merged = union([old, schema])
    return merged.widened(set(old.names) ^ set(schema.names))


def _grown(base: Manifest, schema: Schema, layers: list[Layer], n: int, source: str) -> Manifest:
    from dataclasses import replace

    return replace(base, schema=json.loads(schema.to_json()), layers=[*base.layers, *layers], visible_rows=base.visible_rows + n, max_row_id=base.max_row_id + n, source=source)


def append_csv(catalog: Catalog, path: str, schema: Schema, multiline: bool | None = None) -> Report:
    """Strict CSV as one delta layer. Shared columns must agree with the current schema; new and absent ones become nullable."""
    return import_segmented(catalog, path, schema, rows_per_part=2**62, append=True, multiline=multiline)


def fingerprint(catalog: Catalog, path: str, kind: str) -> str:
    """Names a prepared import: its files with sizes and times, and the format."""
    fs_path = catalog.store._path(path)
    fs = fs_path.getFileSystem(catalog.spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.globStatus(fs_path) or [])
    return hashlib.sha256(repr((found, kind)).encode()).hexdigest()[:32]


def source_bytes(catalog: Catalog, path: str) -> int:
    fs_path = catalog.store._path(path)
    fs = fs_path.getFileSystem(catalog.spark.sparkContext._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(fs_path) or [])


def preflight(catalog: Catalog, path: str, least_free: int = 256 << 20) -> None:
    """Three times the source and a floor must be free."""
    size = source_bytes(catalog, path)
    if catalog.store.free_bytes() < 3 * size + least_free:
        raise ConflictError(f"importing {path} needs {3 * size + least_free} free bytes")


def import_external(
    catalog: Catalog, path: str, schema: Schema, kind: str, max_rejects: int = 0, rejects: str | None = None, unknown: bool = False, accelerators: list[list[str]] | None = None, resume: bool = False, multiline: bool | None = None
) -> Report:
    """Tolerant import of csv, jsonl or json: bad rows are rejected, up to ``max_rejects``, with their reasons.

    rejects: a folder that gets the reject log as JSON lines (row, error, raw).
    resume: reuse rows that an earlier, unfinished import of the same source had already prepared.
    """
    preflight(catalog, path)
    spark = catalog.spark
    if kind == "csv":
        source = R.checked(R.tolerant_csv(spark, path, schema, multiline), schema, True)
    elif kind in ("jsonl", "json"):
        source = R.checked((R.jsonl if kind == "jsonl" else R.json_array)(spark, path, schema, unknown), schema, False)
    else:
        raise InvalidData(f"unknown format {kind!r}")
    literals = kind == "csv"
    spool = f"spool/{fingerprint(catalog, path, kind)}"
    resumed = resume and catalog.store.exists(f"{spool}/_SUCCESS") and catalog.store.exists(f"{spool}.json")
    if resumed:
        counts = catalog.store.read_json(f"{spool}.json")
    else:
        catalog.store.delete(spool)
        r = source.agg(F.count("*").alias("n"), F.count(R.ERROR).alias("bad")).first()
        counts = {"rows": r["n"], "bad": r["bad"]}
        if counts["bad"]:
            log = R.positioned(source.select(R.ERROR, R.RAW, R.FILE, R.BLOCK), 1, "row").where(F.col(R.ERROR).isNotNull()).select("row", F.col(R.ERROR).alias("error"), F.col(R.RAW).alias("raw"))
            if rejects is not None:
                log.write.mode("overwrite").json(rejects)
        if counts["bad"] > max_rejects:
            raise InvalidData(f"{counts['bad']} rows were rejected; the limit is {max_rejects}")
        if counts["rows"] == counts["bad"]:
            raise InvalidData("no row was accepted")
        good = R.positioned(R.stored(source.where(F.col(R.ERROR).isNull()), schema, literals), 0, ROW_ID)
        good.sortWithinPartitions(ROW_ID).write.parquet(catalog.store.at(spool))
        catalog.store.write_json(f"{spool}.json", counts)
    n = counts["rows"] - counts["bad"]
    with catalog.begin() as staging:
        out = staging.write(spark.read.parquet(catalog.store.at(spool)))
        staging.publish(_manifest(staging, schema, out, n, accelerators or [], [], f"{kind}:{path}"))
    catalog.store.delete(spool)
    catalog.store.delete(f"{spool}.json")
    return Report(catalog.current(), counts["rows"], n, counts["bad"], resumed)


def import_parquet(catalog: Catalog, paths: list[str], schema: Schema, hot: list[str] | None = None, accelerators: list[list[str]] | None = None) -> Report:
    """Flat Parquet shards as the first generation; row ids follow path order. hot: columns named hot, of which there must be some and not all."""
    hot = list(hot) if hot is not None else schema.names[:1]
    for c in hot:
        schema[c]
    if not hot or len(set(hot)) >= len(schema.names):
        raise InvalidData("there must be at least one hot and one cold column")
    with catalog.begin(empty=True) as staging:
        raw = R.checked(R.parquet(catalog.spark, paths, schema), schema, False)
        n, schema = _strict(raw, schema)
        out = staging.write(R.positioned(R.stored(raw, schema, False), 0, ROW_ID))
        staging.publish(_manifest(staging, schema, out, n, accelerators or [], hot, "parquet"))
    return Report(catalog.current(), n, n, 0)
