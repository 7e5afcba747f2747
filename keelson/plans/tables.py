"""Star-schema tables as datasets: a natural unique key is the row id, other columns have logical types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..schema import ROW_ID, Column, Schema

SCHEMAS: dict[str, tuple[str, Schema]] = {
    "orders": ("o_orderkey", Schema((Column("o_custkey", "signed"), Column("o_orderstatus"), Column("o_orderpriority")))),
    "customer": ("c_custkey", Schema((Column("c_name"), Column("c_nationkey", "signed"), Column("c_mktsegment", normalization="trim_lowercase")))),
    "part": ("p_partkey", Schema((Column("p_name"), Column("p_brand"), Column("p_type"), Column("p_size", "unsigned")))),
    "events": ("event_id", Schema((Column("user_id", "signed"), Column("event_type", nullable=True, null_values=("view",))))),
    "lineitem": ("", Schema((Column("l_orderkey", "signed"), Column("l_partkey", "signed"), Column("l_suppkey", "signed"), Column("l_linenumber", "signed"), Column("l_returnflag"), Column("l_linestatus")))),
    "nation": ("n_nationkey", Schema((Column("n_name"), Column("n_regionkey", "signed")))),
    "region": ("r_regionkey", Schema((Column("r_name"),))),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, Schema]:
    """(typed rows with ids, schema). Columns that already have their stored type are only cast, so filters reach the scan."""
    key, schema = SCHEMAS[name]
    df = table(spark, sf_dir, name)
    values = []
    for c in schema.columns:
        raw = F.col(c.name)
        plain = c.logical_type not in ("text", "timestamp") or (c.normalization == "none" and not c.null_values)
        values.append((raw.cast(c.spark_type) if plain else canonical.stored(raw, c)).alias(c.name))
    ids = [F.col(key).cast("bigint").alias(ROW_ID)] if key else [F.lit(None).cast("bigint").alias(ROW_ID)]
    return df.select(*ids, *values), schema
