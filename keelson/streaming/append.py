"""Micro-batches of a stream as delta layers: every batch is one append, published once.

The manifest keeps the last batch of every stream beside the rows that came
with it, so a batch that Spark repeats after a failure isn't appended twice,
whatever was published or vacuumed since. A rollback takes both back.
"""

from __future__ import annotations

import json
from contextlib import suppress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import canonical
from ..operators.catalog import Catalog, Layer, Manifest
from ..operators.mutation import append_layer
from ..operators.versioned import dense_ids
from ..plans.shared import materialised
from ..schema import ROW_ID, Schema


def _has(manifest: Manifest | None, stream: str, batch: int) -> bool:
    return manifest is not None and manifest.streams.get(stream, -1) >= batch


class _Repeated(Exception):
    pass


def append_batch(catalog: Catalog, rows: DataFrame, schema: Schema, stream: str, batch: int) -> None:
    """Append string columns named like the schema's as one layer (or as the base of an empty bucket)."""
    if _has(catalog.manifest() if catalog.current() is not None else None, stream, batch):
        return
    tag, last = f"stream:{stream}:{batch}", {stream: batch}
    typed = materialised(rows.select(*[canonical.stored(F.col(f"`{c.name}`").cast("string"), c).alias(c.name) for c in schema.columns]))
    if typed.isEmpty():
        return
    with suppress(_Repeated), catalog.begin() as staging:
        if _has(staging.base, stream, batch):
            raise _Repeated  # appended by another run while this one waited
        if staging.base is None:
            path = staging.write(dense_ids(typed))
            n = staging.read(path).count()
            raw = json.loads(schema.to_json())
            staging.publish(Manifest(0, raw, [Layer(0, path, n, raw)], None, n, n - 1, source=tag, streams=last))
        else:
            append_layer(catalog, staging, staging.base, typed, schema, tag, last)


def append_stream(catalog: Catalog, source: DataFrame, schema: Schema, checkpoint: str, name: str = "append") -> StreamingQuery:
    """Start a stream whose batches become delta layers; runs until what is there is read."""
    return source.writeStream.foreachBatch(lambda df, k: append_batch(catalog, df, schema, name, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["ROW_ID", "append_batch", "append_stream"]
