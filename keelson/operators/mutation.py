"""Insert, update and delete transactions as delta layers, and compaction back to one base."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidData, InvalidRequest, NotFound
from ..schema import ROW_ID, Schema
from .catalog import Catalog, Layer, Manifest
from .versioned import DELETED, VISIBILITY_SCHEMA, merge_visibility


#: Row ids that a filter names one by one, and rows of one file of a transaction's layer.
PUSHED_IDS, LAYER_ROWS = 1000, 1_000_000


@dataclass(frozen=True)
class Insert:
    values: dict[str, str | None]


@dataclass(frozen=True)
class Update:
    row_id: int
    values: dict[str, str | None]


@dataclass(frozen=True)
class Delete:
    row_id: int


Mutation = Insert | Update | Delete


def from_json(text: str | list) -> list[Mutation]:
    raw = json.loads(text) if isinstance(text, str) else text
    kinds = {"insert": Insert, "update": Update, "delete": Delete}
    try:
        return [kinds[x["op"]](**{k: v for k, v in x.items() if k != "op"}) for x in raw]
    except (KeyError, TypeError) as e:
        raise InvalidRequest(f"malformed mutation: {e}") from None


@dataclass
class Transaction:
    """The net effect of a list of mutations."""

    updates: dict[int, dict] = field(default_factory=dict)
    deletes: set[int] = field(default_factory=set)
    inserts: list[dict] = field(default_factory=list)


def _value(schema: Schema, name: str, raw: str | None):
    spec = schema[name]
    if raw is None:
        if not spec.nullable:
            raise InvalidRequest(f"column {name} is not nullable")
        return None
    return spec.value(raw)  # a null literal is ordinary text here


def prepare(mutations: list[Mutation], schema: Schema) -> Transaction:
    """Check mutations against the schema and fold them: later patches overlay earlier ones, a delete cancels an update."""
    if not mutations:
        raise InvalidRequest("a transaction needs at least one mutation")
    tx = Transaction()
    for m in mutations:
        if isinstance(m, Insert):
            for name in m.values:
                schema[name]
            row = {}
            for c in schema.columns:
                if c.name not in m.values and not c.nullable:
                    raise InvalidRequest(f"an insert lacks column {c.name}")
                row[c.name] = _value(schema, c.name, m.values.get(c.name))
            tx.inserts.append(row)
        elif isinstance(m, Update):
            if m.row_id in tx.deletes:
                raise InvalidRequest(f"row {m.row_id} is already deleted in this transaction")
            patch = {n: _value(schema, n, v) for n, v in m.values.items()}
            tx.updates.setdefault(m.row_id, {}).update(patch)
        else:
            tx.updates.pop(m.row_id, None)
            tx.deletes.add(m.row_id)
    return tx


def named(rows: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The rows that may have one of the ids, by a filter that reaches the scan: the ids themselves, or their range where there are many."""
    ids = sorted(ids)
    if len(ids) <= PUSHED_IDS:
        return rows.where(F.col(ROW_ID).isin(ids))
    return rows.where(F.col(ROW_ID).between(ids[0], ids[-1]))


def patched(rows: DataFrame, updates: dict[int, dict], schema: Schema) -> DataFrame:
    """The rows named by ``updates`` with their patches; a patched null is a value like any other, so each column has a flag."""
    fields = [T.StructField(ROW_ID, T.LongType())]
    for i, c in enumerate(schema.columns):
        fields += [T.StructField(f"_v{i}", c.spark_type), T.StructField(f"_s{i}", T.BooleanType())]
    from decimal import Decimal

    data = []
    for row_id, patch in updates.items():
        line: list = [row_id]
        for c in schema.columns:
            v = patch.get(c.name)
            line += [Decimal(v) if c.logical_type == "unsigned" and v is not None else v, c.name in patch]
        data.append(tuple(line))
    patches = rows.sparkSession.createDataFrame(data, T.StructType(fields))
    joined = named(rows, updates).join(patches, ROW_ID)
    return joined.select(ROW_ID, *[F.when(F.col(f"_s{i}"), F.col(f"_v{i}")).otherwise(F.col(f"`{c.name}`")).alias(c.name) for i, c in enumerate(schema.columns)])


def inserted(spark: SparkSession, rows: list[dict], first: int, schema: Schema) -> DataFrame:
    from decimal import Decimal

    struct = T.StructType([T.StructField(ROW_ID, T.LongType()), *schema.struct().fields])
    data = [(first + i, *[Decimal(v) if c.logical_type == "unsigned" and (v := r[c.name]) is not None else r[c.name] for c in schema.columns]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, struct)


def _check_ids(view: DataFrame, ids: set[int]) -> None:
    if ids:
        wanted = view.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"{ROW_ID} bigint")
        missing = wanted.join(named(view, ids).select(ROW_ID), ROW_ID, "left_anti").orderBy(ROW_ID).limit(5).collect()
        if missing:
            raise NotFound(f"rows {[r[0] for r in missing]} don't exist")


@dataclass
class Report:
    generation: int
    inserted: int
    updated: int
    deleted: int
    visible_rows: int
    inserted_ids: list[int]


def apply(catalog: Catalog, mutations: list[Mutation]) -> Report:
    """Publish a transaction as one delta layer and a new visibility map, all or nothing."""
    with catalog.begin() as staging:
        m = staging.base
        if m is None:
            raise NotFound("no dataset to change")
        schema = Schema.from_json(m.schema)
        tx = prepare(mutations, schema)
        view = catalog._view(m)
        _check_ids(view, set(tx.updates) | tx.deletes)
        rows = m.visible_rows - len(tx.deletes) + len(tx.inserts)
        if rows < 1:
            raise InvalidData("a transaction can't delete all rows")
        number = max(x.number for x in m.layers) + 1
        parts = []
        if tx.updates:
            parts.append(patched(view, tx.updates, schema))
        if tx.inserts:
            parts.append(inserted(catalog.spark, tx.inserts, m.max_row_id + 1, schema))
        layers = list(m.layers)
        if parts:
            df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            # an exchange after the join: the scan keeps its tasks, and the layer, no larger than the list, gets few files
            files = max(1, (len(tx.updates) + len(tx.inserts)) // LAYER_ROWS)
            layers.append(Layer(number, staging.write(df.repartitionByRange(files, ROW_ID)), len(tx.updates) + len(tx.inserts), json.loads(schema.to_json())))
        changes = [(i, number) for i in tx.updates] + [(i, DELETED) for i in tx.deletes]
        visibility = m.visibility
        if changes:
            new = catalog.spark.createDataFrame(changes, VISIBILITY_SCHEMA)
            old = staging.read(m.visibility) if m.visibility else None
            visibility = staging.write(merge_visibility(old, new))
        staging.publish(replace(m, layers=layers, visibility=visibility, visible_rows=rows, max_row_id=m.max_row_id + len(tx.inserts), source="mutation"))
    ids = list(range(m.max_row_id + 1, m.max_row_id + 1 + len(tx.inserts)))
    return Report(catalog.current(), len(tx.inserts), len(tx.updates), len(tx.deletes), rows, ids)


def rewrite(catalog: Catalog, mutations: list[Mutation]) -> int:
    """A transaction as a new base instead of a delta layer: for lists that change much of the dataset. Ids stay."""
    with catalog.begin() as staging:
        m = staging.base
        if m is None:
            raise NotFound("no dataset to change")
        schema = Schema.from_json(m.schema)
        tx = prepare(mutations, schema)
        view = catalog._view(m)
        _check_ids(view, set(tx.updates) | tx.deletes)
        changed = set(tx.updates) | tx.deletes
        out = view
        if changed:
            gone = catalog.spark.createDataFrame([(i,) for i in sorted(changed)], f"{ROW_ID} bigint")
            out = view.join(gone, ROW_ID, "left_anti")
        if tx.updates:
            out = out.unionByName(patched(view, tx.updates, schema))
        if tx.inserts:
            out = out.unionByName(inserted(catalog.spark, tx.inserts, m.max_row_id + 1, schema))
        path = staging.write(out.repartitionByRange(ROW_ID))
        n = staging.read(path).count()
        if not n:
            raise InvalidData("a transaction can't delete all rows")
        copies = {"+".join(a): {path: staging.clustered(path, a)} for a in m.accelerators}
        staging.publish(replace(m, layers=[Layer(0, path, n, m.schema)], visibility=None, visible_rows=n, max_row_id=m.max_row_id + len(tx.inserts), copies=copies, source="rewrite"))
    return catalog.current()


def append_layer(catalog: Catalog, staging, m: Manifest, rows: DataFrame, schema: Schema, source: str, streams: dict[str, int] | None = None) -> int:
    """Stage ``rows`` (without ids) as a delta layer of its own schema; returns their number."""
    from ..schema import union
    from .versioned import dense_ids

    merged = union([Schema.from_json(m.schema), schema])
    have, new = set(Schema.from_json(m.schema).names), set(schema.names)
    merged = merged.widened((have | new) - (have & new))
    path = staging.write(dense_ids(rows, m.max_row_id + 1))
    n = staging.read(path).count()
    if not n:
        raise InvalidData("nothing to append")
    layer = Layer(max(x.number for x in m.layers) + 1, path, n, json.loads(schema.to_json()))
    staging.publish(replace(m, schema=json.loads(merged.to_json()), layers=[*m.layers, layer], visible_rows=m.visible_rows + n, max_row_id=m.max_row_id + n, source=source, streams=streams or {}))
    return n


def compact(catalog: Catalog) -> int:
    """The visible rows as one clean base: ids, accelerators and hot columns stay, and so does the highest id ever given."""
    with catalog.begin() as staging:
        m = staging.base
        if m is None:
            raise NotFound("no dataset to compact")
        view = catalog._view(m).repartitionByRange(ROW_ID)
        path = staging.write(view)
        n = staging.read(path).count()
        copies = {"+".join(a): {path: staging.clustered(path, a)} for a in m.accelerators}
        staging.publish(replace(m, layers=[Layer(0, path, n, m.schema)], visibility=None, visible_rows=n, copies=copies, source="compaction"))
    return catalog.current()

