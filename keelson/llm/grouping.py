"""Groups of segments under one anchor, cut into blocks of bounded size.

A group of more than ``most`` units is dealt into blocks by segment hash; every
pair of blocks is one work unit, so that any two segments of the group meet in
at least one unit and no unit grows with the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(rows: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """``rows`` aggregated by ``keys``, for a join by the same keys.

    An extra column that follows from the keys takes part in the grouping, so
    the result isn't already dealt by the keys: the join gets an exchange on
    either side, and a hot key's partition can be split.
    """
    return rows.groupBy(*keys, F.pmod(F.xxhash64(*keys), F.lit(1024)).alias("_apart")).agg(*aggs).drop("_apart")


def block_units(rows: DataFrame, keys: list[str], member: Column, cost: Column, most: int) -> DataFrame:
    """``rows`` with ``unit`` (its two block numbers, and ``own``, the row's block), once for every unit a row belongs to."""
    sums = apart(rows, keys, F.greatest(F.lit(1), F.ceil(F.sum(cost) / F.lit(most))).cast("int").alias("_blocks"))
    own = F.pmod(member, F.col("_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    pairs = F.transform(others, lambda o: F.struct(F.least(o, own).alias("a"), F.greatest(o, own).alias("b"), own.alias("own")))
    single = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("own")))
    return rows.join(sums, keys).withColumn("unit", F.explode(F.when(F.col("_blocks") == 1, single).otherwise(pairs))).drop("_blocks")


def batches_of_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: str, most: int) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted rows: as many groups as fit ``most``, or one larger group.

    ``size`` names a column with each row's cost.
    """
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.column(size).to_numpy().sum() for t in held) < most:
            continue
        table = pa.concat_tables(held)
        costs = np.cumsum(table.column(size).to_numpy())
        new = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(new), -1)[:-1]  # the last group may go on in the next batch
        a = 0
        while True:
            done = costs[a - 1] if a else 0
            later = cuts[cuts > a]
            if not len(later) or costs[-1] - done < most:
                break
            fits = later[costs[later - 1] - done <= most]
            b = int(fits[-1]) if len(fits) else int(later[0])
            yield table.slice(a, b - a)
            a = b
        held = [table.slice(a)]
    if held:
        table = pa.concat_tables(held)
        if table.num_rows:
            yield table
