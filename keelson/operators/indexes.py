"""Accelerators, column statistics, the candidate portfolio, and logical explain reports.

An accelerator is a set of columns and a copy of the base layer that is
range-partitioned and sorted by them. A request with an equality on each of
the columns reads the copy, where Parquet's statistics skip nearly all files
and row groups; layers without a copy are read as they are.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import replace
from fractions import Fraction
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConflictError, NotFound
from ..plans.request import Request, prepare, route
from ..plans.shared import BROADCAST_ROWS, materialised
from ..schema import ROW_ID, Schema
from ..sources.imports import check_accelerator
from . import versioned
from .catalog import Catalog, Dataset, Manifest, Staging

#: Bytes of a dictionary's values up to which it is broadcast, and the share of all rows above which a value of a larger one is.
BROADCAST_BYTES, HOT_SHARE = 8 << 20, 1000


def add(catalog: Catalog, columns: list[str]) -> int:
    """A new generation that also has this accelerator: a copy of the base layer clustered by its columns."""
    with catalog.begin() as staging:
        m = staging.base
        if m is None:
            raise NotFound("no dataset")
        check_accelerator(Schema.from_json(m.schema), columns)
        key = sorted(columns)
        if key in m.accelerators:
            raise ConflictError(f"accelerator {key} exists")
        staging.publish(replace(m, accelerators=sorted([*m.accelerators, key]), copies=m.copies | copied(staging, m, key), source="index-add"))
    return catalog.current()


def drop(catalog: Catalog, columns: list[str]) -> int:
    with catalog.begin() as staging:
        m = staging.base
        key = sorted(columns)
        if m is None or key not in m.accelerators:
            raise NotFound(f"accelerator {key}")
        copies = {a: of for a, of in m.copies.items() if a != "+".join(key)}
        staging.publish(replace(m, accelerators=[a for a in m.accelerators if a != key], copies=copies, source="index-drop"))
    return catalog.current()


def rebuild(catalog: Catalog, columns: list[str]) -> int:
    """The accelerator's copy, written anew from the base layer."""
    with catalog.begin() as staging:
        m = staging.base
        if m is None or sorted(columns) not in m.accelerators:
            raise NotFound(f"accelerator {sorted(columns)}")
        staging.publish(replace(m, copies=m.copies | copied(staging, m, sorted(columns)), source="index-rebuild"))
    return catalog.current()


def copied(staging: Staging, m: Manifest, columns: list[str]) -> dict[str, dict[str, str]]:
    """The entry of ``copies`` for an accelerator; a base without one of its columns has none."""
    base = m.layers[0]
    if not set(columns) <= set(Schema.from_json(base.schema).names):
        return {}
    return {"+".join(columns): {base.path: staging.clustered(base.path, columns)}}


def listing(dataset: Dataset) -> list[dict]:
    """Every column's own access path, then the accelerators with the number of layers that have a clustered copy."""
    single = [{"columns": [c], "kind": "parquet-statistics"} for c in dataset.schema.names]
    m = dataset.manifest
    return single + [{"columns": a, "kind": "clustered-copy", "layers": sum(x.path in m.copies.get("+".join(a), {}) for x in m.layers)} for a in m.accelerators]


def representation(rows: int, cardinality: int) -> str:
    """What a column's row sets would take least room as: bitmaps of a bit per row and value, or lists of 32-bit ids."""
    bitmaps, ids = cardinality * rows // 8, 4 * rows
    return "bitmap" if bitmaps < ids else "list"


def key_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (composite) key."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def distinct_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct().agg(F.count("*").alias("n"))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, token): dense tokens of the distinct values in byte order; null, if there is one, comes first."""
    from .versioned import dense_ids

    c = F.col(f"`{column}`")
    values = materialised(df.select(c).distinct().orderBy(c.asc_nulls_first()))
    return dense_ids(values, 0, "token")


def encoded(df: DataFrame, column: str) -> DataFrame:
    """Every row, null or not, with its value's ``token`` in the column's dictionary.

    A dictionary within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` goes to the
    rows, which stay where they are. In a larger one that holds for the values
    with more than one row in ``HOT_SHARE``; the rest is dealt by value, where
    no value can fill a task.
    """
    c = F.col(f"`{column}`")
    tokens = dictionary(df, column)
    wide = F.octet_length(c.cast("string"))
    r = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(wide), F.lit(0)).alias("bytes")).first()
    tokens = tokens.withColumnRenamed(column, "_value")
    joined = lambda rows, some: rows.join(some, c.eqNullSafe(F.col("_value"))).drop("_value")
    if r["n"] <= BROADCAST_ROWS and r["bytes"] <= BROADCAST_BYTES:
        return joined(df, F.broadcast(tokens))
    least = df.count() // HOT_SHARE
    hot = F.broadcast(materialised(df.groupBy(c.alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select("_hot")))
    often = joined(df, F.broadcast(tokens.join(hot, F.col("_value").eqNullSafe(F.col("_hot")), "left_semi")))
    return often.unionByName(joined(df.join(hot, c.eqNullSafe(F.col("_hot")), "left_anti"), tokens))


def token_matches(df: DataFrame, column: str, token: int) -> DataFrame:
    """The rows whose value has this token in the column's dictionary; the one value goes to the rows."""
    wanted = dictionary(df, column).where(F.col("token") == token).select(column)
    return df.where(F.col(column).isNotNull()).join(F.broadcast(wanted), column, "left_semi")


def bitmap_hits(df: DataFrame, predicates: list, row_id: str = ROW_ID) -> DataFrame:
    """The number of rows in all predicates, by bitmaps of their row ids in buckets of a fixed size."""
    parts = [
        df.where(p).groupBy(F.bitmap_bucket_number(row_id).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row_id)).alias("bits")).withColumn("part", F.lit(i)) for i, p in enumerate(predicates)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    both = every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("parts")).where(F.col("parts") == len(predicates))
    return both.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("hits"))


def cardinalities(df: DataFrame, schema: Schema) -> DataFrame:
    """One row (column, cardinality) per column: distinct values, plus one for a nullable column.

    Each column is read and aggregated by itself, so no row is repeated for every column.
    """

    def one(c) -> DataFrame:
        values = df.select(F.col(f"`{c.name}`").alias("v")).where("v IS NOT NULL").distinct()
        return values.agg((F.count("*") + F.lit(int(c.nullable))).alias("cardinality")).select(F.lit(c.name).alias("column"), "cardinality")

    return reduce(DataFrame.unionByName, [one(c) for c in schema.columns])


def stats(catalog: Catalog) -> dict:
    """Column cardinalities of the base layer, and sizes."""
    m = catalog.manifest()
    number, base = catalog.layers(m)[0]
    if number is None:
        base = base.where(F.col(versioned.LAYER) == m.layers[0].number)
    found = {r["column"]: r["cardinality"] for r in cardinalities(base, Schema.from_json(m.layers[0].schema)).collect()}
    return catalog.status() | {"base_rows": m.layers[0].rows, "cardinalities": found}


def portfolio(sizes: list[int], widest: int, most: int, keyspace: int) -> list[tuple[int, ...]]:
    """The ``most`` best sets of 2 to ``widest`` columns with at most ``keyspace`` keys.

    A set's worth is its number of keys for each of its columns, as an exact
    fraction. Of equal worth, the narrower set comes first, then the one whose
    columns come first.
    """
    keys = {s: math.prod(sizes[c] for c in s) for n in range(2, widest + 1) for s in combinations(range(len(sizes)), n)}
    fitting = (s for s, space in keys.items() if space <= keyspace)
    return heapq.nsmallest(most, fitting, key=lambda s: (-Fraction(keys[s], len(s)), len(s), s))


def explain(dataset: Dataset, request: Request) -> dict:
    """The logical route, what each layer has for it, and Spark's physical plan.

    For every layer: the route taken there, the access paths that the scan
    uses, the rows that its equalities leave as candidates, and whether one of
    its equality values doesn't occur there at all. One aggregation over the
    rows with any of the values counts them.
    """
    prepared = prepare(request.filters, dataset.schema)
    equal = [p for p in prepared if p.op == "eq"]
    kind, catalog, m = route(prepared), dataset.catalog, dataset.manifest
    accelerator = dataset.accelerator(request)
    copies = m.copies.get(accelerator, {})
    counted = {}
    if equal:
        rows = versioned.layered(catalog.layers(m, accelerator), dataset.schema).where(reduce(Column.__or__, [p.predicate() for p in equal]))
        each = [F.count_if(p.predicate()).alias(f"n{i}") for i, p in enumerate(equal)]
        both = F.count_if(reduce(Column.__and__, [p.predicate() for p in equal])).alias("candidates")
        counted = {r[versioned.LAYER]: r for r in rows.groupBy(versioned.LAYER).agg(both, *each).collect()}
    out = []
    for x in m.layers:
        names = set(Schema.from_json(x.schema).names)
        if any(not p.matches(None) for p in prepared if p.spec.name not in names):
            out.append({"layer": x.number, "route": "empty", "indexes": [], "candidates": 0, "dictionary_miss": bool(equal)})
            continue
        own = accelerator.split("+") if x.path in copies else []
        used = ["+".join(own)] * bool(own) + sorted({p.spec.name for p in equal} - set(own))
        found = counted.get(x.number)
        miss = bool(equal) and (found is None or any(not found[f"n{i}"] for i in range(len(equal))))
        candidates = (found["candidates"] if found is not None else 0) if equal else x.rows
        how = "exact_rows" if kind == "equality" else "row_candidates" if kind == "candidate_first" else "canonical_scan"
        out.append({"layer": x.number, "route": how, "indexes": used, "candidates": candidates, "dictionary_miss": miss})
    plan = dataset.rows(request)._jdf.queryExecution().explainString(catalog.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {"route": kind, "layers": out, "physical": plan}
