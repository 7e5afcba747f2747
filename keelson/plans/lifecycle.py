"""Named queries about a dataset's life: imports, generations, seals, leases, accelerators, reports and the service.

Each runs the operations and returns what they leave behind; the SQL says from
the tables alone what that has to be.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KeelsonError
from ..operators import digests, indexes, mutation, telemetry
from ..operators.buckets import check_id
from ..operators.catalog import BEAT, LOCK, STALE, Catalog
from ..schema import ROW_ID, Column, Schema
from ..sources import attached, export, imports
from ..streaming.append import append_batch
from .catalogue import _BY_NAME, _as_files, _customers, _mutated, _transferred, register
from .request import MAX_LIMIT, Eq, Range, Request
from .shared import scratch
from .tables import SCHEMAS, table, view


def outcome(work: Callable) -> str:
    """"done", or the kind of error."""
    try:
        work()
    except KeelsonError as e:
        return type(e).__name__
    return "done"


def _steps(*names: tuple[str, str, str]) -> str:
    """SQL for rows (step, outcome, rows); rows is an expression over n, the number of customers."""
    return " UNION ALL ".join(f"SELECT '{a}' AS step, '{b}' AS outcome, ({c})::BIGINT AS rows FROM (SELECT count(*) AS n FROM customer)" for a, b, c in names)


def _frame(spark, steps: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(steps, "step string, outcome string, rows bigint")


def _rows(catalog: Catalog) -> int:
    return catalog.dataset().frame.count()


# -- imports


_SEGMENT = "market\nsegment"


@register('SELECT c_custkey::DECIMAL(20,0) AS c_custkey, c_name, c_mktsegment AS segment FROM customer')
def import_csv_folder(spark, sf_dir):
    """Files with headers in different orders, and a name with a line break: every file goes by its own header."""
    folder = scratch(spark, "folder")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias(_SEGMENT))
    low = F.col("c_custkey") <= 500
    rows.where(low).write.option("header", True).csv(folder)
    rows.where(~low).select(_SEGMENT, "c_custkey", "c_name").write.mode("append").option("header", True).csv(folder)
    catalog = Catalog(spark, scratch(spark, "imported"))
    imports.import_csv(catalog, folder, Schema((Column("c_custkey", "unsigned"), Column("c_name"), Column(_SEGMENT))))
    return catalog.dataset().frame.drop(ROW_ID).withColumnRenamed(_SEGMENT, "segment")


@register(_steps(("first", "done", "n"), ("second", "ConflictError", "n"), ("replaced", "done", "n")))
def import_initial_only(spark, sf_dir):
    folder, schema = _as_files(spark, sf_dir, "csv")
    catalog = Catalog(spark, scratch(spark, "initial"))
    out = []
    for step, initial in (("first", True), ("second", True), ("replaced", False)):
        found = outcome(lambda initial=initial: imports.import_csv(catalog, folder, schema, initial=initial))
        out.append((step, found, _rows(catalog)))
    return _frame(spark, out)


@register(_steps(("other writer", "ConflictError", "0"), ("resumed", "done", "n"), ("anew", "done", "n")))
def import_resume(spark, sf_dir):
    """Rows prepared before another writer got in the way are used by the next try."""
    folder, schema = _as_files(spark, sf_dir, "jsonl")
    catalog = Catalog(spark, scratch(spark, "resume"))
    with catalog._locked():
        out = [("other writer", outcome(lambda: imports.import_external(catalog, folder, schema, "jsonl")), 0)]
    r = imports.import_external(catalog, folder, schema, "jsonl", resume=True)
    out.append(("resumed", "done" if r.resumed else "prepared again", r.accepted_rows))
    r = imports.import_external(catalog, folder, schema, "jsonl", resume=True)
    out.append(("anew", "done" if not r.resumed else "resumed", r.accepted_rows))
    return _frame(spark, out)


@register(_steps(("enough", "done", "0"), ("too little", "ConflictError", "0")))
def disk_preflight(spark, sf_dir):
    folder, _ = _as_files(spark, sf_dir, "csv")
    catalog = Catalog(spark, scratch(spark, "preflight"))
    catalog.store.mkdirs()
    check = lambda least: outcome(lambda: imports.preflight(catalog, folder, least))
    return _frame(spark, [("enough", check(0), 0), ("too little", check(1 << 60), 0)])


@register("SELECT n_nationkey::BIGINT AS _row_id, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def attached_point_get(spark, sf_dir):
    """Every row by its id, one at a time."""
    found = attached.Attached(spark, [f"{sf_dir}/nation.parquet"])
    rows = [(i, r["n_name"], r["n_regionkey"]) for i in range(found.rows) if (r := found.row(i)) is not None]
    return spark.createDataFrame(rows, f"{ROW_ID} bigint, n_name string, n_regionkey string")


# -- accelerators


_PAIR = ["c_mktsegment", "c_nationkey"]


def _accelerated(spark, sf_dir) -> Catalog:
    catalog = _mutated(spark, sf_dir)
    indexes.add(catalog, _PAIR)
    return catalog


@register(f"""SELECT * FROM (SELECT _row_id, c_name, CASE _row_id WHEN 4 THEN 99 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM ({_BY_NAME}) WHERE _row_id <> 2)
WHERE c_mktsegment = 'building' AND c_nationkey = 7""")
def accelerated_eq(spark, sf_dir):
    """Two equalities answered from the clustered copy of the base, with a delta layer beside it."""
    d = _accelerated(spark, sf_dir).dataset()
    request = Request(filters=(Eq("c_mktsegment", "building"), Eq("c_nationkey", "7")))
    from .query import matches

    assert d.accelerator(request) is not None
    return matches(d.source(request), request, d.schema)


@register("SELECT 1 AS copies, true AS narrow")
def accelerator_layout(spark, sf_dir):
    """The copy's files hold key ranges that don't overlap: one page of keys is one run of files."""
    catalog = _accelerated(spark, sf_dir)
    copies = catalog.manifest().copies["+".join(_PAIR)]
    rows = [spark.read.parquet(catalog.store.at(p)) for p in copies.values()]
    key = F.struct(*_PAIR, ROW_ID)
    spans = sorted((r["a"], r["b"]) for df in rows for r in df.groupBy(F.col("_metadata.file_path")).agg(F.min(key).alias("a"), F.max(key).alias("b")).collect())
    narrow = all(spans[i][1] < spans[i + 1][0] for i in range(len(spans) - 1))
    return spark.createDataFrame([(len(copies), narrow)], "copies int, narrow boolean")


@register(" UNION ALL ".join(f"SELECT '{a}' AS step, '{b}' AS outcome, {c}::BIGINT AS rows" for a, b, c in (("one column", "InvalidData", 0), ("add", "done", 1), ("again", "ConflictError", 1), ("rebuild", "done", 1), ("drop", "done", 0), ("drop again", "NotFound", 0))))
def accelerator_lifecycle(spark, sf_dir):
    catalog = _customers(spark, sf_dir)
    steps = (
        ("one column", lambda: indexes.add(catalog, ["c_name"])), ("add", lambda: indexes.add(catalog, _PAIR)), ("again", lambda: indexes.add(catalog, _PAIR[::-1])),
        ("rebuild", lambda: indexes.rebuild(catalog, _PAIR)), ("drop", lambda: indexes.drop(catalog, _PAIR)), ("drop again", lambda: indexes.drop(catalog, _PAIR)),
    )
    out = []
    for step, work in steps:
        found = outcome(work)
        out.append((step, found, sum(x["kind"] == "clustered-copy" for x in indexes.listing(catalog.dataset()))))
    return _frame(spark, out)


@register("""SELECT k AS "column", CASE WHEN c * n // 8 < 4 * n THEN 'bitmap' ELSE 'list' END AS kind FROM (SELECT 'o_custkey' AS k, count(DISTINCT o_custkey) AS c, count(*) AS n FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), count(*) FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders)""")
def index_representation(spark, sf_dir):
    orders, schema = view(spark, sf_dir, "orders")
    rows = orders.count()
    kinds = [(r["column"], indexes.representation(rows, r["cardinality"])) for r in indexes.cardinalities(orders, schema).collect()]
    return spark.createDataFrame(kinds, "column string, kind string")


@register("SELECT o_orderkey AS _row_id, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderpriority = (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 1 OFFSET 2)")
def filter_token(spark, sf_dir):
    """Rows by the token of a value in the column's dictionary."""
    return indexes.token_matches(view(spark, sf_dir, "orders")[0], "o_orderpriority", 2)


_EXPLAINED = """WITH b AS (SELECT count(*) AS n, count(*) FILTER (lower(c_mktsegment) = 'building') AS s FROM customer)
SELECT 'browse' AS route, 0 AS layer, 'canonical_scan' AS how, '' AS indexes, n AS candidates, false AS miss FROM b UNION ALL SELECT 'browse', 1, 'canonical_scan', '', 2, false
UNION ALL SELECT 'equality', 0, 'exact_rows', 'c_name', 0, true UNION ALL SELECT 'equality', 1, 'exact_rows', 'c_name', 1, false
UNION ALL SELECT 'equality', 0, 'exact_rows', 'c_mktsegment+c_name', 0, true UNION ALL SELECT 'equality', 1, 'exact_rows', 'c_mktsegment,c_name', 1, false
UNION ALL SELECT 'candidate_first', 0, 'row_candidates', 'c_mktsegment', s, s = 0 FROM b
UNION ALL SELECT 'candidate_first', 1, 'row_candidates', 'c_mktsegment', count(*) FILTER (lower(c_mktsegment) = 'building'), count(*) FILTER (lower(c_mktsegment) = 'building') = 0 FROM (SELECT c_mktsegment FROM customer ORDER BY c_name LIMIT 1 OFFSET 4)
UNION ALL SELECT 'range_decomposed', 0, 'canonical_scan', '', n, false FROM b UNION ALL SELECT 'range_decomposed', 1, 'canonical_scan', '', 2, false
UNION ALL SELECT 'scan', 0, 'canonical_scan', '', n, false FROM b UNION ALL SELECT 'scan', 1, 'canonical_scan', '', 2, false"""


@register(_EXPLAINED)
def explain_routes(spark, sf_dir):
    """Route, access paths, candidates and missing values of every layer, for six kinds of request."""
    catalog = _mutated(spark, sf_dir)
    indexes.add(catalog, ["c_name", "c_mktsegment"])
    d, out = catalog.dataset(), []
    name, none, building, nation = Eq("c_name", "New"), Eq("c_mktsegment", "none"), Eq("c_mktsegment", "Building"), Range("c_nationkey", "1", "9")
    for filters in ((), (name,), (name, none), (building, nation), (nation,), (Range("c_nationkey", gte="3"),)):
        r = indexes.explain(d, Request(filters=filters))
        out += [(r["route"], x["layer"], x["route"], ",".join(x["indexes"]), x["candidates"], x["dictionary_miss"]) for x in r["layers"]]
    return spark.createDataFrame(out, "route string, layer int, how string, indexes string, candidates bigint, miss boolean")


# -- generations


@register(_steps(("created", "1", "n"), ("deleted", "2", "n - 1"), ("rolled back", "1", "n"), ("restored", "3", "n"), ("compacted", "4", "n"), ("vacuumed", "2", "2"), ("recovered", "4", "2")))
def generation_lifecycle(spark, sf_dir):
    """The current generation and its rows after each step; of the vacuum, generations removed and left."""
    catalog = _customers(spark, sf_dir)
    state = lambda step: (step, str(catalog.current()), catalog.verify()["visible_rows"])
    out = [state("created")]
    mutation.apply(catalog, [mutation.Delete(0)])
    out.append(state("deleted"))
    catalog.rollback(1)
    out.append(state("rolled back"))
    copy = scratch(spark, "backup")
    catalog.backup(copy)
    catalog.restore(copy)
    out.append(state("restored"))
    mutation.compact(catalog)
    out.append(state("compacted"))
    with catalog.lease(1):
        out.append(("vacuumed", str(len(catalog.vacuum(retain=1))), len(catalog.generations())))
    out.append(("recovered", str(catalog.recover()), len(catalog.generations())))
    return _frame(spark, out)


@register(_steps(("unchanged", "done", "n"), ("file added", "InvalidData", "n")))
def publish_presealed(spark, sf_dir):
    """A backup restored by its own seal, held against file names and sizes only."""
    source = _customers(spark, sf_dir)
    copy = scratch(spark, "sealed")
    source.backup(copy)
    catalog = Catalog(spark, scratch(spark, "presealed"))
    out = [("unchanged", outcome(lambda: catalog.restore(copy, sealed=True)), _rows(catalog))]
    backup = Catalog(spark, copy)
    backup.store.write(f"{backup.manifest().layers[0].path}/more.parquet", "x")
    out.append(("file added", outcome(lambda: catalog.restore(copy, sealed=True)), catalog.manifest().visible_rows))
    return _frame(spark, out)


@register(_steps(("listed", "1", "n"), ("no such generation", "NotFound", "n"), ("legacy", "0", "n")))
def generation_resolve(spark, sf_dir):
    """Resolving by number, and a folder from before there were generations."""
    catalog = _customers(spark, sf_dir)
    out = [("listed", ",".join(map(str, catalog.generations())), catalog.dataset(1).frame.count()), ("no such generation", outcome(lambda: catalog.dataset(9)), _rows(catalog))]
    catalog.store.write_json("manifest.json", catalog.store.read_json(f"generations/{1:020d}/manifest.json"))
    catalog.store.delete("CURRENT")
    catalog.store.delete("generations")
    return _frame(spark, [*out, ("legacy", str(catalog.manifest().id), _rows(catalog))])


@register("SELECT 1::BIGINT AS missing, 2::BIGINT AS extra, 'InvalidData' AS verdict")
def seal_difference(spark, sf_dir):
    catalog = _customers(spark, sf_dir)
    layer = catalog.manifest().layers[0].path
    catalog.store.delete(next(iter(catalog.store.files(layer))))
    for k in range(2):
        catalog.store.write(f"{layer}/more-{k}.parquet", "x")
    missing, extra = catalog.differences()
    return spark.createDataFrame([(len(missing), len(extra), outcome(catalog.verify))], "missing bigint, extra bigint, verdict string")


@register(_steps(("intact", "done", "n"), ("byte changed", "InvalidData", "n"), ("file gone", "InvalidData", "n")))
def tamper_detection(spark, sf_dir):
    """A seal finds a changed byte (same size) and a missing file."""
    catalog = _customers(spark, sf_dir)
    n = catalog.manifest().visible_rows
    out = [("intact", outcome(catalog.verify), n)]
    name = next(iter(catalog.store.files(catalog.manifest().layers[0].path)))
    fs, at = catalog.store._fs, catalog.store._p(name)
    stream = fs.open(at)
    data = bytes(stream.readNBytes(1 << 30))
    stream.close()
    changed = fs.create(at, True)
    changed.write(bytearray(data[:5] + bytes([data[5] ^ 1]) + data[6:]))
    changed.close()
    out.append(("byte changed", outcome(catalog.verify), n))
    catalog.store.delete(name)
    return _frame(spark, [*out, ("file gone", outcome(catalog.verify), n)])


@register("SELECT sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, true AS agree FROM customer")
def file_digests(spark, sf_dir):
    """A file hashed by the executors and by the driver."""
    folder = scratch(spark, "digests")
    table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_name").coalesce(1).write.text(folder)  # one file, the thing under test
    store = Catalog(spark, folder).store
    sizes = store.files("")
    base = store.qualified()
    how = digests._mounted if base.startswith("file:") else digests._remote
    from urllib.parse import urlparse

    told = {r["file"]: r["sha256"] for r in how(spark, store, sorted(sizes), urlparse(base).path).collect()}
    return spark.createDataFrame([(d, d == digests.digests(spark, store, sizes)[f]) for f, d in told.items()], "sha256 string, agree boolean")


@register(_steps(("live reader", "1", "2"), ("dead reader", "1", "1"), ("live writer", "ConflictError", "n"), ("dead writer", "done", "n - 2")))
def leases_and_locks(spark, sf_dir):
    """Generations removed and left by a vacuum with a reader; and a writer that finds a lock."""
    catalog = _customers(spark, sf_dir)
    n = catalog.manifest().visible_rows
    old = lambda name: catalog.store._fs.setTimes(catalog.store._p(name), int((time.time() - STALE - 10 * BEAT) * 1000), -1)
    for k in range(2):
        mutation.apply(catalog, [mutation.Delete(k)])
    with catalog.lease(1):
        out = [("live reader", str(len(catalog.vacuum(retain=1))), len(catalog.generations()))]
    catalog.store.write(f"leases/{1:020d}/dead", "dead")
    old(f"leases/{1:020d}/dead")
    out.append(("dead reader", str(len(catalog.vacuum(retain=1))), len(catalog.generations())))
    catalog.store.create(LOCK, "someone")
    out.append(("live writer", outcome(lambda: mutation.compact(catalog)), n))
    old(LOCK)
    out.append(("dead writer", outcome(catalog.recover), _rows(catalog)))
    return _frame(spark, out)


@register("SELECT 2 * count(*) + 2 AS rows, 1::BIGINT AS last FROM nation")
def stream_exactly_once(spark, sf_dir):
    """Batches that come again after other transactions and a vacuum aren't appended again."""
    catalog = Catalog(spark, scratch(spark, "stream"))
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").drop("n_nationkey")
    for batch in (0, 1):
        append_batch(catalog, rows, SCHEMAS["nation"][1], "s", batch)
    for name in ("x", "y"):
        mutation.apply(catalog, [mutation.Insert({"n_name": name, "n_regionkey": "1"})])
    catalog.vacuum(retain=1)
    for batch in (0, 1):
        append_batch(catalog, rows, SCHEMAS["nation"][1], "s", batch)
    last = catalog.manifest().streams["s"]
    return catalog.dataset().frame.agg(F.count("*").alias("rows")).withColumn("last", F.lit(last).cast("bigint"))


@register(f"""SELECT _row_id, c_name, CASE _row_id WHEN 4 THEN 99 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM ({_BY_NAME}) WHERE _row_id <> 2
UNION ALL SELECT count(*), 'New', 5, 'none' FROM customer""")
def rewrite_transaction(spark, sf_dir):
    """The same transaction as a new base."""
    catalog = _customers(spark, sf_dir)
    mutation.rewrite(catalog, [mutation.Delete(2), mutation.Update(4, {"c_nationkey": "99"}), mutation.Insert({"c_name": "New", "c_nationkey": "5", "c_mktsegment": " NONE "})])
    return catalog.dataset().frame


@register("SELECT * FROM (VALUES ('default', 'default'), ('third', 'A third'), ('other', 'Other')) AS t(id, name)")
def bucket_list(spark, sf_dir):
    b = _transferred(spark, sf_dir, False)
    b.create("third")
    b.rename("third", "A third")
    return spark.createDataFrame(b.list(), "id string, name string")


@register(" UNION ALL ".join(f"SELECT '{a}' AS step, '{b}' AS outcome, 0::BIGINT AS rows" for a, b in (("create", "done"), ("create again", "ConflictError"), ("bad id", "InvalidRequest"), ("rename default", "ConflictError"), ("delete default", "ConflictError"), ("delete with reader", "ConflictError"), ("delete", "done"), ("delete again", "NotFound"))))
def bucket_rules(spark, sf_dir):
    b = _transferred(spark, sf_dir, False)
    out = [(step, outcome(work), 0) for step, work in (("create", lambda: b.create("third")), ("create again", lambda: b.create("third")), ("bad id", lambda: b.create("Third!")), ("rename default", lambda: b.rename("default", "x")), ("delete default", lambda: b.delete("default")))]
    with b.catalog("other").lease():
        out.append(("delete with reader", outcome(lambda: b.delete("other")), 0))
    out += [("delete", outcome(lambda: b.delete("other")), 0), ("delete again", outcome(lambda: b.delete("other")), 0)]
    return _frame(spark, out)


_NAMES = {"../a b/ç": "a_b", "report 2024.csv": "report_2024.csv", "...": "export", "x" * 130: "x" * 120}
_IDS = {"a": "done", "0-b_c": "done", "Upper": "InvalidRequest", "": "InvalidRequest", "-a": "InvalidRequest", "a" * 65: "InvalidRequest"}


@register(" UNION ALL ".join(f"SELECT '{a}' AS raw, '{b}' AS made" for a, b in [*_NAMES.items(), *_IDS.items()]))
def safe_names(spark, sf_dir):
    """File names for downloads, and the rule for bucket ids."""
    return spark.createDataFrame([*[(x, export.safe_name(x)) for x in _NAMES], *[(x, outcome(lambda x=x: check_id(x))) for x in _IDS]], "raw string, made string")


# -- the query log


def _logged(spark, sf_dir) -> Catalog:
    catalog = _mutated(spark, sf_dir)
    d = catalog.dataset()
    for f in ((Eq("c_name", "New"), Eq("c_mktsegment", "none")), (Eq("c_name", "New"),), (Eq("c_name", "New"), Eq("c_mktsegment", "none"))):
        telemetry.query(catalog, d, Request(filters=f))
    return catalog


@register("SELECT 3::BIGINT AS query_count, 2::BIGINT AS shapes, 2::BIGINT AS observed")
def query_log_report(spark, sf_dir):
    r = telemetry.report(_logged(spark, sf_dir))
    return spark.createDataFrame([(r["query_count"], len(r["shapes"]), r["recommendations"][0]["observed_queries"])], "query_count bigint, shapes bigint, observed bigint")


@register("SELECT 'c_mktsegment,c_name' AS columns, 'eq,eq' AS operators, 1::BIGINT AS hits, true AS equality UNION ALL SELECT 'c_name', 'eq', 1, true UNION ALL SELECT 'c_mktsegment,c_name', 'eq,eq', 1, true")
def query_log_events(spark, sf_dir):
    """The log's own lines."""
    log = telemetry.events(_logged(spark, sf_dir))
    return log.select(F.array_join("columns", ",").alias("columns"), F.array_join("operators", ",").alias("operators"), "hits", F.col("optimized_equality_route").alias("equality"))


@register("""SELECT q, l[ceil((len(l) - 1) * q)::INT + 1] AS micros FROM (SELECT list(o_custkey ORDER BY o_custkey) AS l FROM orders), (VALUES (0.0::DOUBLE), (0.5), (0.95), (0.99), (1.0)) AS t(q)""")
def benchmark_percentiles(spark, sf_dir):
    quantiles = [0.0, 0.5, 0.95, 0.99, 1.0]
    found = telemetry.percentiles(table(spark, sf_dir, "orders").select("o_custkey"), quantiles)
    return spark.createDataFrame(list(zip(quantiles, found, strict=True)), "q double, micros bigint")


@register("SELECT 3::BIGINT AS runs, count(*) AS hits, true AS ordered FROM customer WHERE lower(c_mktsegment) = 'building'")
def benchmark_request(spark, sf_dir):
    t = telemetry.benchmark(_customers(spark, sf_dir).dataset(), Request(filters=(Eq("c_mktsegment", "building"),)), iterations=3, warmups=1)
    ordered = 0 < t.min_micros <= t.median_micros <= t.p95_micros <= t.p99_micros <= t.max_micros
    return spark.createDataFrame([(t.runs, t.hits, ordered)], "runs bigint, hits bigint, ordered boolean")


@register(_steps(("within", "done", "0"), ("examines too much", "LimitExceeded", "0"), ("limit too large", "InvalidRequest", "0"), ("no limit", "InvalidRequest", "0"), ("empty range", "InvalidRequest", "0"), ("empty list", "InvalidRequest", "0")))
def query_ceilings(spark, sf_dir):
    d = _customers(spark, sf_dir).dataset()
    scan = (Range("c_nationkey", gte="3"),)
    run = lambda **r: outcome(lambda: d.query(Request(**r)))
    out = [
        ("within", run(filters=scan, max_rows_examined=1 << 40)), ("examines too much", run(filters=scan, max_rows_examined=1)), ("limit too large", run(limit=MAX_LIMIT + 1)), ("no limit", run(limit=0)),
        ("empty range", run(filters=(Range("c_nationkey", "5", "4"),))), ("empty list", outcome(lambda: d.query(Request.from_json({"filters": [{"op": "in", "column": "c_name", "values": []}]})))),
    ]
    return _frame(spark, [(a, b, 0) for a, b in out])


# -- command line and service


def _schema_text() -> dict:
    return json.loads(SCHEMAS["customer"][1].to_json())


def _csv_text(spark, sf_dir) -> str:
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").select("c_name", "c_nationkey", "c_mktsegment")
    return "\n".join(["c_name,c_nationkey,c_mktsegment", *export.csv_lines(rows, rows.columns).toPandas()["line"]]) + "\n"  # an upload is a client's file


class _Client:
    """A service in this process with a key for each role."""

    def __init__(self, spark, **config):
        from ..service.app import ROLES, Config, Service

        self.root = scratch(spark, "service")
        keys = [{"id": r, "token": r, "role": r} for r in ROLES]
        self.service = Service(spark, Config(self.root, keys, rate_per_minute=0, uploads=scratch(spark, "uploads").removeprefix("file://").removeprefix("file:"), max_body_bytes=1 << 30, **config))

    def __call__(self, method: str, path: str, body=None, role: str = "admin", raw: bytes | None = None, **headers) -> tuple[int, dict]:
        data = raw if raw is not None else json.dumps(body).encode() if body is not None else b""
        return self.service.handle(method, path, {"authorization": f"Bearer {role}"} | headers, data)

    def wait(self, job: dict) -> dict:
        while job["stage"] not in ("complete", "failed"):
            time.sleep(0.05)
            job = self("GET", f"/v1/admin/imports/{job['id']}")[1]
        return job


@register(_steps(("created", "uploading", "0"), ("wrong offset", "409", "0"), ("too early", "409", "0"), ("done", "complete", "n"), ("over a dataset", "409", "n")))
def upload_job(spark, sf_dir):
    """A file uploaded in chunks at their offsets, then imported."""
    client, data = _Client(spark), _csv_text(spark, sf_dir).encode()
    body = {"schema": _schema_text(), "size": len(data), "fingerprint": hashlib.sha256(data[: 1 << 20]).hexdigest()}
    job = client("POST", "/v1/admin/imports", body)[1]
    out, at = [("created", job["stage"], job["received"])], f"/v1/admin/imports/{job['id']}"
    out.append(("wrong offset", str(client("PUT", at + "/chunk", raw=data[:9], **{"x-upload-offset": "7"})[0]), 0))
    out.append(("too early", str(client("POST", at + "/complete")[0]), 0))
    for k in range(0, len(data), 1 << 16):
        job = client("PUT", at + "/chunk", raw=data[k : k + (1 << 16)], **{"x-upload-offset": str(k)})[1]
    job = client.wait(client("POST", at + "/complete")[1])
    out.append(("done", job["stage"], job["rows"]))
    out.append(("over a dataset", str(client("POST", "/v1/admin/imports", body)[0]), client("GET", "/v1/stats")[1]["visible_rows"]))
    return _frame(spark, out)


@register(_steps(("first", "200", "n"), ("second", "409", "n"), ("reader", "403", "n")))
def upload_single(spark, sf_dir):
    """A whole CSV in one request."""
    client, body = _Client(spark), {"schema": _schema_text(), "csv": _csv_text(spark, sf_dir)}
    out = []
    for step, role in (("first", "admin"), ("second", "admin"), ("reader", "read")):
        status = client("POST", "/v1/admin/import/csv", body, role)[0]
        out.append((step, str(status), client("GET", "/v1/stats")[1]["visible_rows"]))
    return _frame(spark, out)


def _served(spark, sf_dir, **config) -> _Client:
    client = _Client(spark, **config)
    client("POST", "/v1/admin/import/csv", {"schema": _schema_text(), "csv": _csv_text(spark, sf_dir)})
    return client


@register("""SELECT '_row_id,c_name,c_nationkey' AS line UNION ALL SELECT (row_number() OVER (ORDER BY c_custkey) - 1) || ',' || c_name || ',' || c_nationkey FROM customer QUALIFY lower(c_mktsegment) = 'building'""")
def export_link(spark, sf_dir):
    """What is behind the link of an export of all matches."""
    client = _served(spark, sf_dir)
    link = client("POST", "/v1/export", {"filters": [{"op": "eq", "column": "c_mktsegment", "value": "building"}], "select": ["c_name", "c_nationkey"]}, "read")[1]
    lines = [(x.rstrip("\n"),) for x in client.service.download(link["url"].split("/")[-1])]
    return spark.createDataFrame(lines, "line string")


_ROUTES = (
    ("GET /healthz", "200", ""), ("GET /readyz", "200", ""), ("GET /v1/buckets", "200", ""), ("GET /v1/none", "404", ""), ("GET /v1/schema", "200", "read"), ("POST /v1/query", "200", "read"), ("POST /v1/row", "200", "read"), ("POST /v1/explain", "200", "read"),
    ("POST /v1/mutate", "403", "read"), ("POST /v1/mutate", "200", "write"), ("POST /v1/admin/compact", "403", "write"), ("POST /v1/admin/compact", "200", "admin"), ("POST /v1/admin/verify", "200", "admin"), ("POST /v1/query", "401", "nobody"),
)


@register(" UNION ALL ".join(f"SELECT '{a}' AS step, '{b}' AS outcome, {i}::BIGINT AS rows" for i, (a, b, _) in enumerate(_ROUTES)))
def http_routes(spark, sf_dir):
    """The status of requests by different roles, in order."""
    client = _served(spark, sf_dir)
    bodies = {"/v1/row": {"row_id": 3}, "/v1/mutate": {"mutations": [{"op": "delete", "row_id": 1}]}, "/v1/query": {"filters": []}, "/v1/explain": {"filters": []}}
    out = []
    for i, (step, _, role) in enumerate(_ROUTES):
        method, path = step.split()
        body = bodies.get(path, {}) if method == "POST" else None
        out.append((step, str(client(method, path, body, role or "read")[0]), i))
    return _frame(spark, out)


@register("""SELECT 'query' AS tool, count(*) FILTER (lower(c_mktsegment) = 'building') AS hits FROM customer UNION ALL SELECT 'attached_query', (SELECT count(*) FROM nation WHERE n_regionkey = 2)
UNION ALL SELECT 'import_parquet', (SELECT count(*) FROM region) UNION ALL SELECT 'stats', count(*) FROM customer""")
def tools_rpc(spark, sf_dir):
    """Four tools called by JSON-RPC: a query, a query of files in place, a job that imports Parquet shards, and statistics."""
    client = _served(spark, sf_dir, attached={"nations": [f"{sf_dir}/nation.parquet"]}, sources=[sf_dir])

    def call(tool: str, **arguments) -> dict:
        reply = client("POST", "/mcp", {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})[1]
        return json.loads(reply["result"]["content"][0]["text"])

    eq = lambda column, value: [{"op": "eq", "column": column, "value": value}]
    out = [("query", call("query", filters=eq("c_mktsegment", "building"))["stats"]["hits"]), ("attached_query", len(call("attached_query", name="nations", filters=eq("n_regionkey", "2"))["rows"]))]
    call("buckets_create", id="regions")
    schema = Schema((Column("r_regionkey", "signed"), Column("r_name")))
    job = client.wait(call("import_parquet", bucket="regions", paths=[f"{sf_dir}/region.parquet"], schema=json.loads(schema.to_json())))
    out += [("import_parquet", job["rows"]), ("stats", call("stats")["visible_rows"])]
    return spark.createDataFrame(out, "tool string, hits bigint")


_FIGURES = ("process_uptime_seconds", "process_cpu_seconds", "process_peak_rss_bytes", "process_threads", "filesystem_free_bytes", "spark_parallelism", "service_requests", "service_queries")


@register(" UNION ALL ".join(f"SELECT 'keelson_{x}' AS name, {'true' if x != 'service_queries' else 'false'} AS positive" for x in _FIGURES))
def diagnostics(spark, sf_dir):
    """Figures of the process, the file system, the session and the service, as a scraper gets them."""
    client = _Client(spark)
    lines = dict(x.split(" ") for x in client("GET", "/metrics", role="read")[1]["text"].splitlines())
    return spark.createDataFrame([(f"keelson_{x}", float(lines[f"keelson_{x}"]) > 0) for x in _FIGURES], "name string, positive boolean")


@register(_steps(("import", "done", "n"), ("query", "done", "(SELECT count(*) FROM customer WHERE lower(c_mktsegment) = 'building')"), ("mutate", "done", "n - 1"), ("compact", "2 -> 3", "n - 1"), ("export", "done", "n - 1"), ("bad predicate", "InvalidRequest", "n - 1")))
def command_line(spark, sf_dir):
    """A dataset's way through the command line."""
    from ..__main__ import parser, run

    work = scratch(spark, "cli")
    folder, schema = _as_files(spark, sf_dir, "csv")
    files = Catalog(spark, work).store
    local = work.removeprefix("file://").removeprefix("file:")
    files.mkdirs()
    files.write("schema.json", schema.to_json())
    files.write("m.json", '[{"op":"delete","row_id":0}]')
    cli = lambda *a: run(spark, parser().parse_args([f"{work}/root", *a]))
    out = [("import", "done", cli("import", "csv", folder, "--schema", f"{local}/schema.json", "--initial")["accepted_rows"])]
    out.append(("query", "done", cli("query", "c_mktsegment=Building", "--limit", "5")["stats"]["hits"]))
    out.append(("mutate", "done", cli("mutate", f"{local}/m.json")["visible_rows"]))
    before = cli("generations", "current")
    out.append(("compact", f"{before} -> {cli('compact')}", cli("status")["visible_rows"]))
    cli("export", f"{work}/out", "--format", "jsonl")
    out.append(("export", "done", spark.read.text(f"{work}/out").count()))
    out.append(("bad predicate", outcome(lambda: cli("query", "c_name")), cli("status")["visible_rows"]))
    return _frame(spark, out)
