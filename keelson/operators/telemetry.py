"""The query log and its analytics: shapes, percentiles, index use and recommendations."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Page
from ..plans.request import Eq, In, Request
from ..plans.shared import lookup, materialised
from .catalog import Catalog, Dataset

LOG = "telemetry/queries"
EVENT = (
    "timestamp_ms bigint, columns array<string>, equality_columns array<string>, operators array<string>, elapsed_micros bigint, hits bigint, "
    "rows_examined bigint, pages_touched bigint, hierarchy_lookups bigint, optimized_equality_route boolean, used_indexes array<string>"
)


def event(request: Request, page: Page, used_indexes: list[str]) -> dict:
    kind = lambda f: "eq" if isinstance(f, Eq) else "in" if isinstance(f, In) else "range"
    return {
        "timestamp_ms": int(time.time() * 1000),
        "columns": sorted({f.column for f in request.filters}),
        "equality_columns": sorted({f.column for f in request.filters if isinstance(f, Eq)}),
        "operators": sorted(kind(f) for f in request.filters),
        "elapsed_micros": page.stats.elapsed_micros, "hits": page.stats.hits, "rows_examined": page.stats.rows_examined, "pages_touched": 0, "hierarchy_lookups": 0,
        "optimized_equality_route": page.stats.optimized_equality_route, "used_indexes": used_indexes,
    }


def record(catalog: Catalog, e: dict) -> None:
    """Append one event: a small file of its own, which needs no lock and can't tear another."""
    catalog.store.write(f"{LOG}/{e['timestamp_ms']:015d}-{time.monotonic_ns()}.jsonl", json.dumps(e) + "\n")


def query(catalog: Catalog, dataset: Dataset, request: Request) -> Page:
    """Run a request and log it."""
    page = dataset.query(request)
    used = dataset.accelerator(request)
    record(catalog, event(request, page, [used] if used else []))
    return page


def events(catalog: Catalog) -> DataFrame:
    spark = catalog.spark
    if not catalog.store.list(LOG):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).json(catalog.store.at(LOG))


def shapes(log: DataFrame) -> DataFrame:
    """Per (columns, operators): queries, p50/p95/p99, average and most rows examined; most frequent first."""
    ranked = _ranks(log, ["columns", "operators"])
    return ranked.orderBy(F.desc("queries"), F.desc("p95_micros"), "columns", "operators")


def _ranks(log: DataFrame, keys: list[str]) -> DataFrame:
    """Percentiles by rank without collecting a group: a count per distinct latency first, then running sums.

    Repeated latencies collapse map-side; the window runs over distinct values.
    """
    per = log.groupBy(*keys, "elapsed_micros").agg(F.count("*").alias("c"), F.sum("rows_examined").alias("s"), F.max("rows_examined").alias("m"))
    group = Window.partitionBy(*keys)
    order = group.orderBy("elapsed_micros")
    upto = per.withColumns({"_upto": F.sum("c").over(order), "_n": F.sum("c").over(group)})
    at = lambda p: F.min(F.when(F.col("_upto") > F.round((F.col("_n") - 1) * F.lit(p)), F.col("elapsed_micros")))
    grouped = upto.groupBy(*keys) if keys else upto.groupBy()
    return grouped.agg(
        F.sum("c").alias("queries"), at(0.50).alias("p50_micros"), at(0.95).alias("p95_micros"), at(0.99).alias("p99_micros"),
        (F.sum("s") / F.sum("c")).alias("avg_rows_examined"), F.max("m").alias("max_rows_examined"),
    )


def overall(log: DataFrame) -> DataFrame:
    """One row: query count and p50/p95/p99 of the whole log; zeros for an empty one."""
    keyed = log.withColumn("_all", F.lit(1))
    r = _ranks(keyed, ["_all"]).drop("_all", "avg_rows_examined", "max_rows_examined")
    one = log.sparkSession.range(1).select(F.lit(1).alias("_one"))
    joined = one.join(r.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return joined.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("queries", "p50_micros", "p95_micros", "p99_micros")]).withColumnRenamed("queries", "query_count")


def index_use(log: DataFrame) -> DataFrame:
    return log.select(F.explode("used_indexes").alias("index")).groupBy("index").agg(F.count("*").alias("queries")).orderBy(F.desc("queries"), "index")


def recommendations(log: DataFrame, accelerators: list[list[str]]) -> DataFrame:
    """Sets of two or more equality columns without an accelerator, by queries x ln(average rows examined + 2)."""
    per = log.where(F.size("equality_columns") >= 2).groupBy(F.col("equality_columns").alias("columns")).agg(F.count("*").alias("observed_queries"), F.avg("rows_examined").alias("avg_rows_examined"))
    if accelerators:
        have = log.sparkSession.createDataFrame([(sorted(a),) for a in accelerators], "columns array<string>")
        per = per.join(have, "columns", "left_anti")
    return per.withColumn("score", F.col("observed_queries") * F.log(F.col("avg_rows_examined") + 2)).orderBy(F.desc("score"), "columns")


def report(catalog: Catalog, top: int = 100) -> dict:
    """The whole log's figures, and the ``top`` shapes, indexes and recommendations; their frames have all."""
    log = events(catalog)
    accelerators = catalog.manifest().accelerators if catalog.current() is not None else []
    rows = lambda df: [r.asDict() for r in df.limit(top).collect()]
    return overall(log).first().asDict() | {"shapes": rows(shapes(log)), "index_use": rows(index_use(log)), "recommendations": rows(recommendations(log, accelerators))}


@dataclass
class Timing:
    runs: int
    min_micros: int
    median_micros: int
    p95_micros: int
    p99_micros: int
    max_micros: int
    hits: int


def rank(n: int, q: float) -> int:
    """The place of a percentile among n sorted values: (n - 1) * q, rounded up."""
    return math.ceil((n - 1) * q)


def at_rank(taken: list[int], q: float) -> int:
    """A percentile of sorted timings."""
    return taken[rank(len(taken), q)]


def percentiles(values: DataFrame, quantiles: list[float]) -> list:
    """``at_rank`` of a column of any length; nulls come last, and of no rows every percentile is None.

    A count per distinct value, range-partitioned by value, so repeated values
    can't fill a task. The driver gets a sum per partition and then the values
    at the ranks; running sums are made in the partitions that hold a rank.
    """
    value = F.col(f"`{values.columns[0]}`").alias("v")
    per = materialised(values.select(value).groupBy("v").agg(F.count("*").alias("c")).orderBy(F.col("v").asc_nulls_last()))
    parted = per.withColumn("_part", F.spark_partition_id())
    sums = sorted((r["_part"], r["n"]) for r in parted.groupBy("_part").agg(F.sum("c").alias("n")).collect())
    n = sum(c for _, c in sums)
    if not n:
        return [None] * len(quantiles)
    wanted, before = [], 0
    for part, c in sums:
        wanted += [(part, r, r - before) for r in {rank(n, q) for q in quantiles} if before <= r < before + c]
        before += c
    order = Window.partitionBy("_part").orderBy(F.col("v").asc_nulls_last())
    upto = parted.where(F.col("_part").isin(sorted({w[0] for w in wanted}))).withColumn("_upto", F.sum("c").over(order))
    at = lookup(values.sparkSession, wanted, "_part int, _rank bigint, _at bigint")
    hit = (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("c"))
    found = {r["_rank"]: r["v"] for r in upto.join(at, "_part").where(hit).select("_rank", "v").collect()}
    return [found[rank(n, q)] for q in quantiles]


def benchmark(dataset: Dataset, request: Request, iterations: int = 10, warmups: int = 2) -> Timing:
    """Time a request without logging it. Percentiles are sorted[ceil((n - 1) * q)]."""
    iterations, warmups = min(max(iterations, 1), 50), min(max(warmups, 0), 20)
    taken, hits = [], 0
    for k in range(warmups + iterations):
        began = time.monotonic()
        hits = dataset.query(request).stats.hits
        if k >= warmups:
            taken.append(int((time.monotonic() - began) * 1e6))
    taken.sort()
    return Timing(iterations, taken[0], at_rank(taken, 0.5), at_rank(taken, 0.95), at_rank(taken, 0.99), taken[-1], hits)
