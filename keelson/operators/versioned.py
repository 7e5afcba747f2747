"""The visible view over a base and its delta layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import lookup
from ..schema import ROW_ID, Schema

LAYER, TARGET, DELETED = "_layer", "_target", -1
VISIBILITY_SCHEMA = f"{ROW_ID} bigint, {TARGET} int"


def layered(layers: list[tuple[int | None, DataFrame]], schema: Schema | None = None) -> DataFrame:
    """All layers by name, each row tagged with its layer; absent columns are null. A frame of many layers, with None for a number, has the tags."""
    out = None
    for number, df in layers:
        tagged = df if number is None else df.withColumn(LAYER, F.lit(number))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if schema is not None:
        out = out.select(ROW_ID, *[F.col(f"`{c.name}`").cast(c.spark_type).alias(c.name) for c in schema.columns], LAYER)
    return out


def visible(layers: list[tuple[int, DataFrame]], visibility: DataFrame | None, schema: Schema | None = None) -> DataFrame:
    """The rows that are visible: an id's target layer or its only layer; tombstones go.

    Visibility only has the ids that were changed. Spark picks a broadcast for
    it by its size, or a merge join beyond that.
    """
    rows = layered(layers, schema)
    if visibility is None:
        return rows.drop(LAYER)
    joined = rows.join(visibility, ROW_ID, "left")
    return joined.where(F.col(TARGET).isNull() | (F.col(TARGET) == F.col(LAYER))).drop(LAYER, TARGET)


def latest(layers: list[tuple[int, DataFrame]], deleted: DataFrame | None = None) -> DataFrame:
    """The newest version of each row id without tombstones: the check form of ``visible``."""
    w = Window.partitionBy(ROW_ID).orderBy(F.col(LAYER).desc())
    rows = layered(layers).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", LAYER)
    return rows if deleted is None else rows.join(deleted, ROW_ID, "left_anti")


def merge_visibility(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``new`` entries over ``old`` ones."""
    if old is None:
        return new
    return old.join(new.select(ROW_ID), ROW_ID, "left_anti").unionByName(new)


def dense_ids(rows: DataFrame, first: int = 0, name: str = ROW_ID) -> DataFrame:
    """Dense ids in the order of partitions and of rows in them, from ``first`` on.

    Two passes without a shuffle: a count per partition (one row each, on the
    driver) and then offset + position. ``rows`` must be the same on both
    passes, as file scans with row-wise steps are.
    """
    tagged = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = {r["_part"]: r["count"] for r in tagged.groupBy("_part").count().collect()}
    offsets, total = [], first
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    table = lookup(rows.sparkSession, offsets, "_part int, _first bigint")
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(table, "_part").withColumn(name, F.col("_first") + at).drop("_part", "_at", "_first")
