"""Raw rows of external files: one string column per cell, plus what is wrong with the row.

Readers give frames with the file's position columns (``_file``, ``_block``),
so that row ids follow file and row order without a shuffle.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidData
from ..functions import canonical
from ..plans.shared import lookup
from ..schema import Schema

ERROR, RAW, SHORT, FILE, BLOCK = "_error", "_raw", "_short", "_file", "_block"
_CORRUPT = "_corrupt_record"
HEADER_BYTES, JSON_CHARS = 1 << 16, 1 << 20
_BARE = "\x00bare\x00"  # no cell is this text


def _first_record(spark: SparkSession, path: str) -> str:
    """The first record of one CSV file, line breaks in quotes included; read from its start, no further than needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        source = stream if codec is None else codec.createInputStream(stream)
        data, quoted, seen = b"", False, 0
        while True:
            more = bytes(source.readNBytes(HEADER_BYTES))
            data += more
            for k in range(seen, len(data)):
                if data[k] == 0x22:
                    quoted = not quoted
                elif data[k] in (0x0A, 0x0D) and not quoted:
                    return data[:k].decode()
            seen = len(data)
            if not more:
                return data.decode()
    finally:
        stream.close()


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record of one CSV file."""
    record = _first_record(spark, path).lstrip("\ufeff")
    names = next(csv.reader(io.StringIO(record, newline="")), [])
    if not names:
        raise InvalidData(f"{path} is empty")
    return names


def _groups(spark: SparkSession, path: str, multiline: bool | None) -> list[tuple[list[str], bool, list[str]]]:
    """(header, whether records may span lines, files) for the files of a folder or pattern; each file has a header of its own.

    What is held is a name list per different header and a path per file.
    multiline: None finds out which files need it. A file without such records
    can be split among tasks; small files are one task's work either way.
    """
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        raise InvalidData(f"{path} has no files")
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: tuple(header(spark, f)), files))
    spanning = set(files) if multiline is None else set(files) if multiline else set()
    if multiline is None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in files]
        least = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
        large = [f for f, p in zip(files, paths, strict=True) if p.getFileSystem(conf).getFileStatus(p).getLen() > least]
        if large:
            # a record that spans lines has a line with an odd number of quotes; a lone CR would end a line for one reader only
            plain = [unquote(f) for f in large]
            line, told = F.col("value"), F.col("_metadata.file_path")
            odd = (F.length(line) - F.length(F.translate(line, '"', ""))) % 2 == 1
            found = spark.read.option("lineSep", "\n").text(plain).where(odd | line.rlike("\r.")).select(told.alias("f")).distinct().collect()
            same = lambda f: re.sub("^file:/+", "file:/", f)  # noqa: E731  the two ways in which Spark writes a local path
            odd_files = {same(r["f"]) for r in found}
            spanning -= {f for f in large if same(f) not in odd_files}
    groups: dict[tuple, list[str]] = {}
    for f, names in zip(files, headers, strict=True):
        groups.setdefault((names, f in spanning or any("\n" in n or "\r" in n for n in names)), []).append(f)
    return [(list(names), spans, of) for (names, spans), of in groups.items()]


def _cells(names: list[str]) -> list[str]:
    return [f"c{i}" for i in range(len(names))]


def _csv(spark: SparkSession, files: list[str], names: list[str], multiline: bool) -> DataFrame:
    """Cells c0, c1, ... in file order, the corrupt record, and the file position."""
    struct = T.StructType([*[T.StructField(c, T.StringType()) for c in _cells(names)], T.StructField(_CORRUPT, T.StringType())])
    reader = spark.read.schema(struct).options(header=True, mode="PERMISSIVE", multiLine=multiline, quote='"', escape='"', nullValue=_BARE, emptyValue="", columnNameOfCorruptRecord=_CORRUPT, enforceSchema=True, maxCharsPerColumn=-1)
    return reader.csv([unquote(f) for f in files]).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))


def _tokens(line: SparkColumn) -> SparkColumn:
    """Cells of a CSV record: separators outside quotes, plus one."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "q")
    return F.length(bare) - F.length(F.translate(bare, ",", "")) + 1


def strict_csv(spark: SparkSession, path: str, schema: Schema, multiline: bool | None = None) -> DataFrame:
    """Cells by schema name. Every file's header must name each column once and nothing else, in any order of its own.

    A short row gives nulls (flagged in ``_short``), a long one is an error.
    """

    def of(names: list[str], spans: bool, files: list[str]) -> DataFrame:
        rows = _csv(spark, files, names, spans)
        n = len(names)
        broken = F.col(_CORRUPT).isNotNull()
        rows = rows.withColumn("_count", F.when(broken, _tokens(F.col(_CORRUPT))).otherwise(n))
        cells = [F.when(F.col("_count") > i, F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(name) for i, name in enumerate(names)]
        error = F.when(F.col("_count") > n, F.concat(F.lit("row has too many cells: "), F.col(_CORRUPT))).when(broken & (F.col("_count") == n), F.concat(F.lit("malformed row: "), F.col(_CORRUPT)))
        wide = rows.select(*cells, error.alias(ERROR), (F.col("_count") < n).alias(SHORT), F.col(_CORRUPT).alias(RAW), FILE, BLOCK)
        return wide.select(*[F.col(f"`{c}`") for c in schema.names], ERROR, SHORT, RAW, FILE, BLOCK)

    groups = _groups(spark, path, multiline)
    for names, _, files in groups:
        if len(set(names)) != len(names):
            raise InvalidData(f"duplicate CSV header in {names} of {files[0]}")
        unexpected, missing = set(names) - set(schema.names), set(schema.names) - set(names)
        if unexpected or missing:
            raise InvalidData(f"the CSV header of {files[0]} lacks {sorted(missing)} and has unexpected {sorted(unexpected)}")
    return reduce(DataFrame.unionAll, [of(*g) for g in groups])


def tolerant_csv(spark: SparkSession, path: str, schema: Schema, multiline: bool | None = None) -> DataFrame:
    """As ``strict_csv``, but extra columns are ignored, the last of equal headers wins, and an absent cell is empty text."""

    def of(names: list[str], spans: bool, files: list[str]) -> DataFrame:
        rows = _csv(spark, files, names, spans)
        at = {name: i for i, name in enumerate(names)}
        cells = [F.coalesce(F.col(f"c{at[c]}"), F.lit("")).alias(c) for c in schema.names]
        raw = F.coalesce(F.col(_CORRUPT), F.to_csv(F.struct(*_cells(names))))
        return rows.select(*cells, F.lit(None).cast("string").alias(ERROR), F.lit(False).alias(SHORT), raw.alias(RAW), FILE, BLOCK)

    groups = _groups(spark, path, multiline)
    for names, _, files in groups:
        missing = set(schema.names) - set(names)
        if missing:
            raise InvalidData(f"the CSV header of {files[0]} lacks {sorted(missing)}")
    return reduce(DataFrame.unionAll, [of(*g) for g in groups])


def _json_cells(lines: DataFrame, schema: Schema, unknown: bool) -> DataFrame:
    """From ``_raw`` JSON text: a cell per column, scalars only."""
    parsed = lines.withColumns({"_v": F.try_parse_json(RAW), "_keys": F.json_object_keys(RAW)}).withColumn("_map", F.when(F.col("_keys").isNotNull(), F.from_json(RAW, "map<string,string>")))

    def kind(name: str) -> SparkColumn:
        quoted = name.replace("\\", "\\\\").replace("'", "\\'")
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$['{quoted}']", "variant")), F.lit("VOID"))

    cells, errors = [], [F.when(F.col("_v").isNull(), F.lit("line isn't JSON")), F.when(F.col("_keys").isNull(), F.lit("row isn't a JSON object"))]
    if not unknown:
        extra = F.array_except("_keys", F.array(*[F.lit(c) for c in schema.names]))
        errors.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown field "), F.element_at(extra, 1))))
    for c in schema.columns:
        raw = F.col("_map").getItem(c.name)
        cells.append(raw.alias(c.name))
        errors.append(F.when(kind(c.name).rlike("^(OBJECT|ARRAY)"), F.lit(f"column {c.name} holds a nested value")))
        if not c.nullable:
            errors.append(F.when(F.col("_keys").isNotNull() & raw.isNull(), F.lit(f"column {c.name} is missing or null")))
    position = [c for c in (FILE, BLOCK) if c in lines.columns]
    return parsed.select(*cells, F.coalesce(*errors).alias(ERROR), F.lit(False).alias(SHORT), RAW, *position)


def jsonl(spark: SparkSession, path: str, schema: Schema, unknown: bool = False) -> DataFrame:
    """One JSON object per line; blank lines are skipped, anything else that isn't a flat object is a bad row."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias(RAW), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
    return _json_cells(lines.where(F.length(F.trim(F.regexp_replace(RAW, r"\s", ""))) > 0), schema, unknown)


def _elements(spark: SparkSession, files: list[str]) -> DataFrame:
    """The elements of one top-level array per file, as text, in order: read block by block on a mounted file system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        space = re.compile(r"[ \t\n\r]*")

        def elements(f) -> Iterator[str]:
            text, done, at, state = "", False, 0, "open"
            while True:
                at = space.match(text, at).end()
                if at == len(text) and not done:
                    pass
                elif state == "closed":
                    if at < len(text):
                        raise ValueError("text after the array")
                    return
                elif at == len(text):
                    raise ValueError("the array doesn't end")
                elif state == "open":
                    if text[at] != "[":
                        raise ValueError("no array")
                    at, state = at + 1, "first"
                    continue
                elif text[at] == "]" and state in ("first", "next"):
                    at, state = at + 1, "closed"
                    continue
                elif state == "next":
                    if text[at] != ",":
                        raise ValueError("no comma")
                    at, state = at + 1, "value"
                    continue
                else:
                    try:
                        _, end = decoder.raw_decode(text, at)
                        whole = end < len(text) or done  # a number at the end of a block may go on
                    except ValueError:
                        if done:
                            raise
                        whole = False
                    if whole:
                        yield text[at:end]
                        at, state = end, "next"
                        continue
                more = f.read(max(JSON_CHARS, len(text) - at))  # blocks grow with an element that doesn't fit
                done = not more
                text, at = text[at:] + more, 0

        names = [RAW, FILE, BLOCK]
        for batch in batches:
            for path, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                with open(path, encoding="utf-8-sig") as f:
                    try:
                        for x in elements(f):
                            held.append(x)
                            size += len(x)
                            if size > JSON_CHARS:
                                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([told] * len(held)), pa.array([0] * len(held), pa.int64())], names=names)
                                held, size = [], 0
                    except ValueError as e:
                        raise ValueError(f"{path} isn't a JSON array: {e}") from None
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([told] * len(held)), pa.array([0] * len(held), pa.int64())], names=names)

    rows = spark.createDataFrame([(unquote(re.sub("^file:(//)?", "", f)), f) for f in files], "path string, file string")
    return rows.repartitionByRange(len(files), "file").mapInArrow(run, f"{RAW} string, {FILE} string, {BLOCK} long")


def json_array(spark: SparkSession, path: str, schema: Schema, unknown: bool = False) -> DataFrame:
    """Files that hold one array of objects each; a syntax error fails the whole import.

    Files on a mounted file system are streamed, an element at a time; others
    are values of one row each, which bounds them by an executor's memory.
    """
    files = sorted(spark.read.text(path, wholetext=True).inputFiles())
    if files and all(f.startswith("file:") for f in files):
        each = _elements(spark, files)
        try:
            each.select(F.max(F.length(RAW))).collect()
        except Exception as e:
            found = re.search(r"\S+ isn't a JSON array: [^\n]*", str(e))
            if found is None:
                raise
            raise InvalidData(found[0]) from None
        return _json_cells(each, schema, unknown)
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))
    bad = whole.where("v IS NULL OR NOT schema_of_variant(v) LIKE 'ARRAY%'").select(FILE).limit(1).collect()
    if bad:
        raise InvalidData(f"{bad[0][0]} isn't a JSON array")
    whole.createOrReplaceTempView("_keelson_json")
    each = spark.sql(f"SELECT to_json(e.value) AS {RAW}, t.{FILE}, t.{BLOCK} FROM _keelson_json t, LATERAL variant_explode(t.v) AS e")
    return _json_cells(each, schema, unknown)


def parquet(spark: SparkSession, paths: list[str], schema: Schema) -> DataFrame:
    """Flat Parquet shards in path order, every leaf as text; names must be the schema's."""
    if len(set(paths)) != len(paths):
        raise InvalidData("a shard is listed twice")
    df = spark.read.parquet(*sorted(paths))
    nested = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)]
    if nested:
        raise InvalidData(f"columns {nested} aren't flat")
    if set(df.columns) != set(schema.names):
        raise InvalidData(f"shards have columns {sorted(df.columns)}, the schema {sorted(schema.names)}")
    cells = [F.col(f"`{c}`").cast("string").alias(c) for c in schema.names]
    none = F.lit(None).cast("string")
    return df.select(*cells, none.alias(ERROR), F.lit(False).alias(SHORT), none.alias(RAW), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK))


def checked(rows: DataFrame, schema: Schema, literals: bool) -> DataFrame:
    """Rows with the first problem of each in ``_error``. literals: null literals of the schema count as null."""
    problems = [F.when(~(F.col(SHORT) & F.col(f"`{c.name}`").isNull()), canonical.problem(F.col(f"`{c.name}`"), c, literals)) for c in schema.columns]
    return rows.withColumn(ERROR, F.coalesce(F.col(ERROR), *problems))


def stored(rows: DataFrame, schema: Schema, literals: bool) -> DataFrame:
    """Typed values of checked rows."""
    value = canonical.stored if literals else canonical.typed
    return rows.select(*[value(F.col(f"`{c.name}`"), c).alias(c.name) for c in schema.columns], *[c for c in (FILE, BLOCK) if c in rows.columns])


def positioned(rows: DataFrame, first: int, name: str) -> DataFrame:
    """Dense ids in file and row order, from ``first`` on.

    A first pass counts the rows of each file split (a small row per split on
    the driver); the second adds split offset and position. No shuffle.
    """
    tagged = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = tagged.groupBy("_part", FILE, BLOCK).agg(F.count("*").alias("n"), F.min("_at").alias("_from")).collect()
    offsets, total = [], first
    for r in sorted(counts, key=lambda r: (r[FILE], r[BLOCK], r["_part"])):
        offsets.append((r["_part"], r[FILE], r[BLOCK], r["_from"], total))
        total += r["n"]
    if not offsets:
        return rows.drop(FILE, BLOCK).withColumn(name, F.lit(None).cast("bigint"))
    table = lookup(rows.sparkSession, offsets, f"_part int, {FILE} string, {BLOCK} bigint, _from bigint, _first bigint")
    joined = tagged.join(table, ["_part", FILE, BLOCK])
    return joined.withColumn(name, F.col("_first") + F.col("_at") - F.col("_from")).drop("_part", "_at", "_from", "_first", FILE, BLOCK)
