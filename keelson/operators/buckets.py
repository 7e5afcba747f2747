"""Independent buckets below one root: lifecycle, combination and row transfer."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, InvalidData, InvalidRequest, NotFound
from ..schema import ROW_ID, Schema
from . import mutation
from .catalog import Catalog, Layer, Manifest
from .store import Store
from .versioned import dense_ids

DEFAULT = "default"


def check_id(bucket: str) -> str:
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", bucket):
        raise InvalidRequest(f"{bucket!r} isn't a bucket id")
    return bucket


@dataclass
class Transfer:
    rows: int
    moved: bool
    target_generation: int
    warning: str | None = None


class Buckets:
    """``default`` is the root itself; others are folders below ``buckets``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def catalog(self, bucket: str = DEFAULT) -> Catalog:
        check_id(bucket)
        if bucket == DEFAULT:
            return Catalog(self.spark, self.store.root)
        if not self.store.exists(f"buckets/{bucket}/bucket.json"):
            raise NotFound(f"bucket {bucket}")
        return Catalog(self.spark, self.store.at(f"buckets/{bucket}"))

    def create(self, bucket: str, name: str | None = None) -> None:
        check_id(bucket)
        if bucket == DEFAULT or self.store.exists(f"buckets/{bucket}/bucket.json"):
            raise ConflictError(f"bucket {bucket} exists")
        self.store.write_json(f"buckets/{bucket}/bucket.json", {"id": bucket, "name": name or bucket})

    def rename(self, bucket: str, name: str) -> None:
        if bucket == DEFAULT:
            raise ConflictError("the default bucket keeps its name")
        if not name.strip():
            raise InvalidRequest("a bucket needs a name")
        self.catalog(bucket)
        self.store.write_json(f"buckets/{bucket}/bucket.json", {"id": bucket, "name": name})

    def delete(self, bucket: str) -> None:
        if bucket == DEFAULT:
            raise ConflictError("the default bucket can't be deleted")
        if self.catalog(bucket).leased():
            raise ConflictError(f"bucket {bucket} has readers")
        self.store.delete(f"buckets/{bucket}")

    def list(self) -> list[tuple[str, str]]:
        """(id, name): default first, then by name and id."""
        found = []
        for b in self.store.list("buckets"):
            if self.store.exists(f"buckets/{b}/bucket.json"):
                raw = self.store.read_json(f"buckets/{b}/bucket.json")
                found.append((raw["id"], raw["name"]))
        return [(DEFAULT, DEFAULT), *sorted(found, key=lambda x: (x[1], x[0]))]

    def combine(self, sources: list[str], target: str) -> int:
        """All visible rows of the sources, in that order, as a new bucket with dense ids. Schemas must be identical."""
        if not sources or len(set(sources)) != len(sources):
            raise InvalidRequest("combine needs different source buckets")
        check_id(target)
        if target == DEFAULT or self.store.exists(f"buckets/{target}"):
            raise ConflictError(f"bucket {target} exists")
        manifests = [self.catalog(b).manifest() for b in sources]
        if any(m.schema["columns"] != manifests[0].schema["columns"] for m in manifests):
            raise InvalidData("the buckets' schemas differ")
        self.create(target)
        out = self.catalog(target)
        try:
            with out.begin(empty=True) as staging:
                path = staging.write(combined([self.catalog(b)._view(m) for b, m in zip(sources, manifests, strict=True)]))
                n = staging.read(path).count()
                raw = manifests[0].schema
                staging.publish(Manifest(0, raw, [Layer(0, path, n, raw)], None, n, n - 1, source="combine:" + ",".join(sources)))
        except BaseException:
            self.store.delete(f"buckets/{target}")
            raise
        return out.current()

    def transfer(self, source: str, target: str, row_ids: list[int], move: bool = False) -> Transfer:
        """Copy or move rows. The copy commits first; if a move can't delete at the source, that is a warning."""
        if source == target or not row_ids or len(set(row_ids)) != len(row_ids):
            raise InvalidRequest("transfer needs two buckets and different row ids")
        a, b = self.catalog(source), self.catalog(target)
        m = a.manifest()
        view = a._view(m)
        mutation._check_ids(view, set(row_ids))
        if move and len(row_ids) >= m.visible_rows:
            raise InvalidData("a move can't empty its source")
        picked = chosen(view, row_ids)
        empty = b.current() is None
        if not empty and b.manifest().schema["columns"] != m.schema["columns"]:
            raise InvalidData("the buckets' schemas differ")
        with b.begin(empty=empty) as staging:
            if empty:
                path = staging.write(ordered_ids(picked, 0))
                n = staging.read(path).count()
                staging.publish(Manifest(0, m.schema, [Layer(0, path, n, m.schema)], None, n, n - 1, source=f"transfer:{source}"))
            else:
                old = staging.base
                path = staging.write(ordered_ids(picked, old.max_row_id + 1))
                n = staging.read(path).count()
                layer = Layer(max(x.number for x in old.layers) + 1, path, n, json.loads(Schema.from_json(old.schema).to_json()))
                staging.publish(replace(old, layers=[*old.layers, layer], visible_rows=old.visible_rows + n, max_row_id=old.max_row_id + n, source=f"transfer:{source}"))
        warning = None
        if move:
            try:
                mutation.apply(a, [mutation.Delete(i) for i in sorted(row_ids)])
            except Exception as e:
                warning = f"rows were copied but not deleted at the source: {e}"
        return Transfer(len(row_ids), move and warning is None, b.current(), warning)


def chosen(view: DataFrame, row_ids: list[int]) -> DataFrame:
    ids = view.sparkSession.createDataFrame([(i,) for i in row_ids], f"{ROW_ID} bigint")
    return view.join(ids, ROW_ID, "left_semi")


def ordered_ids(rows: DataFrame, first: int) -> DataFrame:
    """New dense ids in the order of the old ones."""
    return dense_ids(_sorted(rows).drop(ROW_ID), first)


def _sorted(rows: DataFrame) -> DataFrame:
    from ..plans.shared import materialised

    return materialised(rows.orderBy(ROW_ID))


def combined(views: list[DataFrame]) -> DataFrame:
    """UNION ALL with dense ids by source and then by old id."""
    out = None
    for k, v in enumerate(views):
        tagged = v.withColumn("_source", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged)
    from ..plans.shared import materialised

    return dense_ids(materialised(out.orderBy("_source", ROW_ID)).drop("_source", ROW_ID))
