"""Command line: python -m keelson ROOT COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import InvalidRequest, KeelsonError
from .operators import indexes, mutation, telemetry
from .operators.buckets import Buckets
from .plans.request import Eq, Request
from .schema import Schema
from .sources import attached, export, imports


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keelson", description="Exact retrieval over versioned tables on Spark.")
    p.add_argument("root")
    p.add_argument("--bucket", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("status", "stats", "verify", "seal", "workload", "compact", "recover"):
        sub.add_parser(name)
    for name in ("query", "explain"):
        c = sub.add_parser(name, help="equality predicates NAME=VALUE")
        c.add_argument("predicates", nargs="*")
        c.add_argument("--is-null", action="append", default=[])
        c.add_argument("--select", action="append", default=[])
        c.add_argument("--limit", type=int, default=100)
    c = sub.add_parser("query-json")
    c.add_argument("file")
    c.add_argument("--no-telemetry", action="store_true")
    c = sub.add_parser("benchmark")
    c.add_argument("file")
    c.add_argument("--iterations", type=int, default=10)
    c.add_argument("--warmups", type=int, default=2)
    c = sub.add_parser("row")
    c.add_argument("row_id", type=int)
    c = sub.add_parser("import")
    c.add_argument("kind", choices=("csv", "external", "segmented", "append", "parquet"))
    c.add_argument("sources", nargs="+")
    c.add_argument("--schema", required=True)
    c.add_argument("--format", choices=("csv", "jsonl", "json"), default="csv")
    c.add_argument("--index", action="append", default=[], help="accelerator columns, comma-separated")
    c.add_argument("--hot", action="append", default=[])
    c.add_argument("--initial", action="store_true")
    c.add_argument("--max-rejects", type=int, default=0)
    c.add_argument("--rejects")
    c.add_argument("--allow-unknown", action="store_true")
    c.add_argument("--resume", action="store_true")
    c.add_argument("--part-rows", type=int, default=1_000_000)
    c = sub.add_parser("mutate")
    c.add_argument("file")
    c = sub.add_parser("indexes")
    c.add_argument("action", choices=("list", "add", "drop", "rebuild"))
    c.add_argument("columns", nargs="*")
    for name in ("backup", "restore"):
        sub.add_parser(name).add_argument("folder")
    c = sub.add_parser("generations")
    c.add_argument("action", choices=("list", "current", "rollback", "vacuum"))
    c.add_argument("id", nargs="?", type=int)
    c.add_argument("--retain", type=int, default=2)
    c.add_argument("--protect", type=int, action="append", default=[])
    c = sub.add_parser("buckets")
    c.add_argument("action", choices=("list", "create", "rename", "delete", "combine", "transfer"))
    c.add_argument("args", nargs="*")
    c.add_argument("--move", action="store_true")
    c = sub.add_parser("export")
    c.add_argument("path")
    c.add_argument("--format", choices=("csv", "jsonl"), default="csv")
    c.add_argument("--request")
    c.add_argument("--max-rows", type=int)
    c.add_argument("--row-id", action="store_true")
    c = sub.add_parser("attached", help="query Parquet files in place; ROOT is ignored")
    c.add_argument("request")
    c.add_argument("paths", nargs="+")
    c = sub.add_parser("serve")
    c.add_argument("--config")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8787)
    c.add_argument("--behind-tls", action="store_true")
    return p


def _equalities(a: argparse.Namespace) -> Request:
    filters = []
    for raw in a.predicates:
        name, sep, value = raw.partition("=")
        if not sep:
            raise InvalidRequest(f"{raw!r} isn't NAME=VALUE")
        filters.append(Eq(name, value))
    return Request((*filters, *[Eq(c, None) for c in a.is_null]), tuple(a.select), a.limit)


def _page(page) -> dict:
    return {"rows": [{"row_id": i, **dict(v)} for i, v in page.rows], "next_cursor": page.next_cursor, "stats": asdict(page.stats)}


def run(spark: SparkSession, a: argparse.Namespace):
    """The result of a parsed command, ready for JSON."""
    buckets = Buckets(spark, a.root)
    read = lambda f: Path(f).read_text()
    if a.command == "buckets":
        x = a.args
        return {
            "list": lambda: buckets.list(), "create": lambda: buckets.create(*x), "rename": lambda: buckets.rename(*x), "delete": lambda: buckets.delete(*x),
            "combine": lambda: buckets.combine(x[:-1], x[-1]), "transfer": lambda: asdict(buckets.transfer(x[0], x[1], [int(i) for i in x[2:]], a.move)),
        }[a.action]()
    if a.command == "attached":
        rows, cursor = attached.Attached(spark, a.paths).query(Request.from_json(read(a.request)))
        return {"rows": [r.asDict() for r in rows], "next_cursor": cursor}
    if a.command == "serve":
        from .service.app import Config, Service
        from .service.http import server

        config = Config(**({"root": a.root} | (json.loads(read(a.config)) if a.config else {})))
        server(Service(spark, config), a.host, a.port, a.behind_tls).serve_forever()
        return None
    catalog = buckets.catalog(a.bucket)
    if a.command == "import":
        schema, accelerators = Schema.from_json(read(a.schema)), [x.split(",") for x in a.index]
        source = a.sources[0]
        return asdict(
            {
                "csv": lambda: imports.import_csv(catalog, source, schema, accelerators, a.initial),
                "external": lambda: imports.import_external(catalog, source, schema, a.format, a.max_rejects, a.rejects, a.allow_unknown, accelerators, a.resume),
                "segmented": lambda: imports.import_segmented(catalog, source, schema, a.part_rows, append=not a.initial and catalog.current() is not None),
                "append": lambda: imports.append_csv(catalog, source, schema),
                "parquet": lambda: imports.import_parquet(catalog, a.sources, schema, a.hot or None, accelerators),
            }[a.kind]()
        )
    simple = {
        "status": catalog.status, "stats": lambda: indexes.stats(catalog), "verify": catalog.verify, "seal": catalog.seal, "recover": catalog.recover, "workload": lambda: telemetry.report(catalog),
        "compact": lambda: mutation.compact(catalog), "mutate": lambda: asdict(mutation.apply(catalog, mutation.from_json(read(a.file)))), "backup": lambda: catalog.backup(a.folder), "restore": lambda: catalog.restore(a.folder),
        "query": lambda: _page(catalog.dataset().query(_equalities(a))), "explain": lambda: indexes.explain(catalog.dataset(), _equalities(a)), "row": lambda: catalog.dataset().row(a.row_id),
        "benchmark": lambda: asdict(telemetry.benchmark(catalog.dataset(), Request.from_json(read(a.file)), a.iterations, a.warmups)),
    }
    if a.command in simple:
        return simple[a.command]()
    if a.command == "query-json":
        request, d = Request.from_json(read(a.file)), catalog.dataset()
        return _page(d.query(request) if a.no_telemetry else telemetry.query(catalog, d, request))
    if a.command == "indexes":
        return indexes.listing(catalog.dataset()) if a.action == "list" else {"add": indexes.add, "drop": indexes.drop, "rebuild": indexes.rebuild}[a.action](catalog, a.columns)
    if a.command == "generations":
        return {"list": catalog.generations, "current": catalog.current, "rollback": lambda: catalog.rollback(a.id), "vacuum": lambda: catalog.vacuum(a.retain, tuple(a.protect))}[a.action]()
    d = catalog.dataset()
    request = Request.from_json(read(a.request)) if a.request else Request()
    from .plans.query import matches

    export.export(matches(d.frame, request, d.schema), a.path, a.format, list(request.select) or d.schema.names, a.max_rows, a.row_id)
    return {"path": a.path}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("keelson").getOrCreate()
    try:
        print(json.dumps(run(spark, a), indent=1, default=str))
    except KeelsonError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
