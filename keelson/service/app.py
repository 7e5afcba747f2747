"""The request handling of the HTTP service, apart from sockets.

Roles are read < write < admin, by bearer token (kept as SHA-256). Requests are
counted per key and minute, and bounded in number and size; queries are clamped
to the service's limits.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import resource
import secrets
import shutil
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import ConflictError, InvalidData, InvalidRequest, KeelsonError, LimitExceeded, NotFound
from ..operators import indexes, mutation, telemetry
from ..operators.buckets import DEFAULT, Buckets
from ..operators.catalog import Catalog, Dataset
from ..plans.query import matches
from ..plans.request import MAX_LIMIT, Request
from ..schema import Schema
from ..sources import export, imports
from ..sources.attached import Attached

ROLES = ("read", "write", "admin")
CHUNK_BYTES, JOB_SECONDS = 4 << 20, 24 * 3600


@dataclass
class Config:
    root: str
    keys: list[dict] = field(default_factory=list)  # id, token, role; without any, every caller is a local admin
    rate_per_minute: int = 600
    concurrency: int = 64
    max_body_bytes: int = 8 << 20
    max_import_bytes: int = 64 << 30
    max_rows_examined: int = 5_000_000
    timeout_ms: int = 30_000
    max_mutations: int = 100_000
    part_rows: int = 1_000_000
    import_builds: int = 1
    uploads: str = ""  # a folder for upload chunks that the executors can read too, by default below the root
    attached: dict[str, list[str]] = field(default_factory=dict)  # Parquet files queried in place, by name
    sources: list[str] = field(default_factory=list)  # folders from which Parquet shards may be imported


class Refused(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def status_of(e: Exception) -> int:
    if isinstance(e, Refused):
        return e.status
    for kind, code in ((InvalidRequest, 400), (InvalidData, 400), (NotFound, 404), (ConflictError, 409), (LimitExceeded, 408)):
        if isinstance(e, kind):
            return code
    return 500


@dataclass
class Job:
    """A resumable upload: created, filled chunk by chunk, completed, and built in the background."""

    id: str
    bucket: str
    schema: dict
    size: int
    fingerprint: str
    stage: str = "uploading"
    received: int = 0
    error: str | None = None
    retry_safe: bool = True
    existing_dataset_preserved: bool = True
    rows: int | None = None
    created: float = field(default_factory=time.time)


class Service:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.buckets = Buckets(spark, config.root)
        self.keys = {hashlib.sha256(k["token"].encode()).hexdigest(): (k["id"], k["role"]) for k in config.keys}
        self.rates: dict[str, tuple[float, int]] = {}
        self.lock, self.slots = threading.Lock(), threading.Semaphore(config.concurrency)
        self.builds = threading.Semaphore(config.import_builds)
        self.counters = dict.fromkeys(("requests", "errors", "auth_failures", "rate_limited", "queries", "mutations"), 0)
        self.datasets: dict[str, Dataset] = {}
        self.jobs: dict[str, Job] = {}
        self.links: dict[str, dict] = {}
        self.shards: dict[str, Attached] = {}
        self.began = time.time()
        self.downloads = threading.Semaphore(2)
        self.uploads = Path(config.uploads or f"{config.root}/uploads")
        routes = [
            ("GET", "/healthz", None, lambda b: {"ok": True}), ("GET", "/readyz", None, self._ready), ("GET", "/metrics", "read", lambda b: {"text": self.metrics()}), ("GET", "/v1/diagnostics", "admin", lambda b: self.diagnostics()),
            ("GET", "/v1/buckets", "read", lambda b: {"buckets": [{"id": i, "name": n} for i, n in self.buckets.list()]}), ("GET", "/v1/stats", "read", lambda b: indexes.stats(self._catalog(b))),
            ("GET", "/v1/schema", "read", lambda b: self._dataset(b).manifest.schema), ("GET", "/v1/workload", "read", lambda b: telemetry.report(self._catalog(b))),
            ("GET", "/v1/generations", "read", lambda b: {"current": self._catalog(b).current(), "generations": self._catalog(b).generations()}), ("GET", "/v1/indexes", "read", lambda b: {"indexes": indexes.listing(self._dataset(b))}),
            ("POST", "/v1/query", "read", self._query), ("POST", "/v1/explain", "read", lambda b: indexes.explain(self._dataset(b), self._request(b))), ("POST", "/v1/row", "read", self._row), ("POST", "/v1/benchmark", "admin", self._benchmark),
            ("GET", "/v1/attached", "read", lambda b: {"attached": [{"name": n, "rows": self._attached(n).rows} for n in sorted(self.config.attached)]}),
            ("POST", "/v1/attached/query", "read", self._attached_query), ("POST", "/v1/attached/row", "read", self._attached_row), ("POST", "/v1/admin/import/parquet", "admin", self._import_parquet),
            ("POST", "/v1/export", "read", self._export), ("POST", "/v1/mutate", "write", self._mutate), ("POST", "/v1/buckets/transfer", "write", self._transfer),
            ("POST", "/v1/admin/buckets/create", "admin", lambda b: self.buckets.create(b["id"], b.get("name"))), ("POST", "/v1/admin/buckets/rename", "admin", lambda b: self.buckets.rename(b["id"], b["name"])),
            ("POST", "/v1/admin/buckets/delete", "admin", lambda b: self.buckets.delete(b["id"])), ("POST", "/v1/admin/buckets/combine", "admin", lambda b: {"generation": self.buckets.combine(b["sources"], b["target"])}),
            ("POST", "/v1/admin/compact", "admin", lambda b: {"generation": mutation.compact(self._catalog(b))}), ("POST", "/v1/admin/vacuum", "admin", lambda b: {"removed": self._catalog(b).vacuum(b.get("retain", 2), tuple(b.get("protect", ())))}),
            ("POST", "/v1/admin/recover", "admin", lambda b: {"generation": self._catalog(b).recover()}), ("POST", "/v1/admin/rollback", "admin", lambda b: self._catalog(b).rollback(b["generation"])), ("POST", "/v1/admin/verify", "admin", lambda b: self._catalog(b).verify()),
            ("POST", "/v1/admin/index/add", "admin", lambda b: {"generation": indexes.add(self._catalog(b), b["columns"])}), ("POST", "/v1/admin/index/drop", "admin", lambda b: {"generation": indexes.drop(self._catalog(b), b["columns"])}),
            ("POST", "/v1/admin/index/rebuild", "admin", lambda b: {"generation": indexes.rebuild(self._catalog(b), b["columns"])}), ("POST", "/v1/admin/imports", "admin", self._job_create),
            ("POST", "/v1/admin/import/csv", "admin", self._import_csv), ("POST", "/mcp", None, None),
        ]
        self.routes: dict[tuple[str, str], tuple[str | None, Callable[[dict], dict | None]]] = {(m, p): (role, f) for m, p, role, f in routes}

    # -- entry

    def handle(self, method: str, path: str, headers: dict[str, str], body: bytes) -> tuple[int, dict]:
        """(status, JSON) of one request."""
        with self.lock:
            self.counters["requests"] += 1
            number = self.counters["requests"]
        if not self.slots.acquire(blocking=False):
            return 503, {"error": "too many requests at once", "request_id": number}
        try:
            return 200, self._route(method, path, headers, body) or {"ok": True}
        except Exception as e:
            with self.lock:
                self.counters["errors"] += 1
            known = isinstance(e, Refused | KeelsonError)
            if isinstance(e, KeyError | TypeError | json.JSONDecodeError):
                return 400, {"error": f"malformed request: {e}", "request_id": number}
            return status_of(e), {"error": str(e) if known else f"internal error: {type(e).__name__}", "request_id": number}
        finally:
            self.slots.release()

    def _route(self, method: str, path: str, headers: dict[str, str], body: bytes) -> dict | None:
        path, _, text = path.partition("?")
        options = dict(x.split("=", 1) for x in text.split("&") if "=" in x)
        parts = path.strip("/").split("/")
        if parts[:3] == ["v1", "admin", "imports"] and len(parts) > 3:
            self._allow(headers, "admin", method != "PUT")
            return self._job(method, parts[3], parts[4] if len(parts) > 4 else "", headers, body)
        if len(body) > self.config.max_body_bytes:
            raise Refused(413, "the body is too large")
        found = self.routes.get((method, path))
        if found is None:
            raise Refused(404, f"no route {method} {path}")
        role, f = found
        if f is None:
            return self._rpc(headers, json.loads(body))
        if role is not None:
            self._allow(headers, role)
        return f(json.loads(body) if body else options)

    def _allow(self, headers: dict[str, str], role: str, counted: bool = True) -> None:
        who, have = "local", "admin"
        if self.keys:
            given = headers.get("authorization", "")
            known = self.keys.get(hashlib.sha256(given[7:].encode()).hexdigest()) if given.lower().startswith("bearer ") else None
            if known is None:
                self.counters["auth_failures"] += 1
                raise Refused(401, "a valid bearer token is needed")
            who, have = known
        if ROLES.index(have) < ROLES.index(role):
            self.counters["auth_failures"] += 1
            raise Refused(403, f"this needs the role {role}")
        if counted and self.config.rate_per_minute:
            with self.lock:
                began, n = self.rates.get(who, (time.monotonic(), 0))
                if time.monotonic() - began >= 60:
                    began, n = time.monotonic(), 0
                if n >= self.config.rate_per_minute:
                    self.counters["rate_limited"] += 1
                    raise Refused(429, "too many requests this minute")
                self.rates[who] = began, n + 1

    # -- data

    def _catalog(self, b: dict) -> Catalog:
        return self.buckets.catalog(b.get("bucket", DEFAULT))

    def _dataset(self, b: dict) -> Dataset:
        """A handle per bucket, made anew when its generation changes."""
        bucket, catalog = b.get("bucket", DEFAULT), self._catalog(b)
        now = catalog.current()
        held = self.datasets.get(bucket)
        if held is None or held.manifest.id != now:
            held = self.datasets[bucket] = catalog.dataset()
        return held

    def _ready(self, _: dict) -> dict:
        if self.buckets.catalog().current() is None:
            raise Refused(503, "no dataset yet")
        return {"ready": True}

    def _request(self, b: dict) -> Request:
        b = {k: v for k, v in b.items() if k not in ("bucket", "format", "minutes", "row_id_column", "max_rows", "iterations", "warmups")}
        b["limit"] = min(int(b.get("limit", 100)), MAX_LIMIT)
        b["max_rows_examined"] = min(int(b.get("max_rows_examined") or self.config.max_rows_examined), self.config.max_rows_examined)
        b["timeout_ms"] = min(int(b.get("timeout_ms") or self.config.timeout_ms), self.config.timeout_ms)
        return Request.from_json(b)

    def _query(self, b: dict) -> dict:
        page = telemetry.query(self._catalog(b), self._dataset(b), self._request(b))
        self.counters["queries"] += 1
        rows = [{"row_id": i, "values": [{"column": c, "value": v} for c, v in values]} for i, values in page.rows]
        return {"rows": rows, "next_cursor": page.next_cursor, "stats": asdict(page.stats) | {"optimized_equality_route": page.stats.optimized_equality_route}}

    def _row(self, b: dict) -> dict:
        found = self._dataset(b).row(int(b["row_id"]))
        if found is None:
            raise NotFound(f"row {b['row_id']}")
        return {"row_id": b["row_id"], "values": [{"column": c, "value": v} for c, v in found]}

    def _benchmark(self, b: dict) -> dict:
        return asdict(telemetry.benchmark(self._dataset(b), self._request(b), int(b.get("iterations", 10)), int(b.get("warmups", 2))))

    def _mutate(self, b: dict) -> dict:
        ops = mutation.from_json(b["mutations"])
        if len(ops) > self.config.max_mutations:
            raise Refused(413, f"at most {self.config.max_mutations} mutations")
        self.counters["mutations"] += 1
        return asdict(mutation.apply(self._catalog(b), ops))

    def _transfer(self, b: dict) -> dict:
        return asdict(self.buckets.transfer(b["source"], b["target"], b["row_ids"], b.get("move", False)))

    # -- files in place

    def _attached(self, name: str) -> Attached:
        if name not in self.config.attached:
            raise NotFound(f"attached files {name}")
        if name not in self.shards:
            self.shards[name] = Attached(self.spark, self.config.attached[name])
        return self.shards[name]

    def _attached_query(self, b: dict) -> dict:
        rows, cursor = self._attached(b["name"]).query(self._request({k: v for k, v in b.items() if k != "name"}))
        return {"rows": [r.asDict() for r in rows], "next_cursor": cursor}

    def _attached_row(self, b: dict) -> dict:
        found = self._attached(b["name"]).row(int(b["row_id"]))
        if found is None:
            raise NotFound(f"row {b['row_id']}")
        return {"row_id": b["row_id"], "values": found}

    def _import_parquet(self, b: dict) -> dict:
        """A job that imports Parquet shards from an allowed folder; its state is read like an upload's."""
        inside = lambda p: ".." not in p.split("/") and any(p.startswith(f.rstrip("/") + "/") for f in self.config.sources)
        if not b["paths"] or not all(inside(p) for p in b["paths"]):
            raise InvalidRequest("shards must lie in one of the service's source folders")
        schema = Schema.from_json(b["schema"])
        job = Job(secrets.token_hex(16), b.get("bucket", DEFAULT), json.loads(schema.to_json()), 0, "", stage="queued")
        self.jobs[job.id] = job
        work = lambda catalog: imports.import_parquet(catalog, b["paths"], schema, b.get("hot"), b.get("indexes"))
        threading.Thread(target=self._run, args=(job, work), daemon=True).start()
        return asdict(job)

    # -- figures

    def diagnostics(self) -> dict:
        """The process, the dataset folder's file system, the session and the counters."""
        usage, root = resource.getrusage(resource.RUSAGE_SELF), self.buckets.store
        sc = self.spark.sparkContext
        return {
            "process": {"uptime_seconds": time.time() - self.began, "cpu_seconds": usage.ru_utime + usage.ru_stime, "peak_rss_bytes": usage.ru_maxrss * 1024, "threads": threading.active_count(), "page_faults": usage.ru_majflt},
            "filesystem": {"free_bytes": root.free_bytes(), "root": root.root},
            "spark": {"version": sc.version, "master": sc.master, "parallelism": sc.defaultParallelism},
            "service": dict(self.counters) | {"jobs": len(self.jobs), "export_links": len(self.links), "open_datasets": len(self.datasets)},
        }

    def metrics(self) -> str:
        """The numbers of ``diagnostics``, a line each, for scrapers."""
        lines = [f"keelson_{part}_{name} {value}" for part, of in self.diagnostics().items() for name, value in of.items() if not isinstance(value, str)]
        return "\n".join(lines) + "\n"

    def _import_csv(self, b: dict) -> dict:
        """A whole small CSV in one request; a populated bucket is refused."""
        self.uploads.mkdir(parents=True, exist_ok=True)
        path = self.uploads / f"{secrets.token_hex(16)}.csv"
        path.write_text(b["csv"])
        try:
            return asdict(imports.import_csv(self._catalog(b), f"file://{os.path.abspath(path)}", Schema.from_json(b["schema"]), b.get("indexes"), initial=True))
        finally:
            path.unlink()

    # -- tools by JSON-RPC

    def _tools(self) -> dict[str, tuple[str, str]]:
        """Tool names (the last parts of a path) and their routes."""
        skip = ("/v1/admin/imports", "/mcp")
        return {p.split("/v1/", 1)[1].replace("admin/", "").replace("/", "_"): (m, p) for m, p in self.routes if p.startswith("/v1/") and p not in skip}

    def _rpc(self, headers: dict[str, str], call: dict) -> dict:
        """initialize, tools/list (what the caller's role may use) and tools/call."""
        reply = {"jsonrpc": "2.0", "id": call.get("id")}
        method, params = call.get("method"), call.get("params") or {}
        if method == "initialize":
            self._allow(headers, "read")
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2025-06-18"), "capabilities": {"tools": {}}, "serverInfo": {"name": "keelson", "version": "1"}}}
        tools = self._tools()
        if method == "tools/list":
            self._allow(headers, "read")
            may = []
            for name, at in sorted(tools.items()):
                with contextlib.suppress(Refused):
                    self._allow(headers, self.routes[at][0] or "read", counted=False)
                    may.append({"name": name, "description": f"{at[0]} {at[1]}", "inputSchema": {"type": "object"}})
            return reply | {"result": {"tools": may}}
        if method != "tools/call" or params.get("name") not in tools:
            return reply | {"error": {"code": -32601, "message": "unknown method or tool"}}
        role, f = self.routes[tools[params["name"]]]
        self._allow(headers, role or "read")
        try:
            result, failed = f(params.get("arguments") or {}) or {"ok": True}, False
        except (KeelsonError, Refused, KeyError, TypeError) as e:
            result, failed = {"error": str(e)}, True
        return reply | {"result": {"content": [{"type": "text", "text": json.dumps(result, default=str)}], "isError": failed}}

    # -- export links

    def _export(self, b: dict) -> dict:
        minutes, kind = int(b.get("minutes", 15)), b.get("format", "csv")
        if not 1 <= minutes <= 1440 or kind not in ("csv", "jsonl"):
            raise InvalidRequest("an export has a format (csv, jsonl) and lasts 1 to 1440 minutes")
        d, request = self._dataset(b), self._request(b)
        matches(d.frame, request, d.schema)  # a bad request fails now
        now = time.time()
        with self.lock:
            self.links = {k: v for k, v in self.links.items() if v["until"] > now}
            if len(self.links) >= 1024:
                raise Refused(429, "too many export links")
            token = secrets.token_urlsafe(32)
            self.links[hashlib.sha256(token.encode()).hexdigest()] = {"until": now + 60 * minutes, "dataset": d, "request": request, "kind": kind, "max_rows": b.get("max_rows"), "row_id": bool(b.get("row_id_column", True))}
        return {"url": f"/exports/{token}", "file": f"{export.safe_name(b.get('bucket', DEFAULT))}.{kind}", "expires_in_seconds": 60 * minutes}

    def download(self, token: str) -> Iterator[str]:
        """The lines behind an export link."""
        link = self.links.get(hashlib.sha256(token.encode()).hexdigest())
        if link is None or link["until"] < time.time():
            raise Refused(404, "no such export")
        if not self.downloads.acquire(blocking=False):
            raise Refused(429, "too many downloads at once")
        try:
            d, request = link["dataset"], link["request"]
            df = matches(d.frame, request, d.schema)
            if link["max_rows"] is not None:
                from ..schema import ROW_ID

                df = df.orderBy(ROW_ID).limit(int(link["max_rows"]))
            columns = list(request.select) or d.schema.names
            for line in export.stream(df, link["kind"], columns, link["row_id"]):
                yield line + "\n"
        finally:
            self.downloads.release()

    # -- upload jobs

    def _job_create(self, b: dict) -> dict:
        self._expire()
        schema = Schema.from_json(b["schema"])
        size = int(b["size"])
        if not 0 < size <= self.config.max_import_bytes:
            raise Refused(413, f"an import has 1 to {self.config.max_import_bytes} bytes")
        if not b.get("append") and self._catalog(b).current() is not None:
            raise ConflictError("the bucket has a dataset; append, or use another bucket")
        for job in self.jobs.values():
            if job.stage == "uploading" and (job.bucket, job.size, job.fingerprint) == (b.get("bucket", DEFAULT), size, b.get("fingerprint", "")) and job.fingerprint:
                return asdict(job)  # goes on where it stopped
        job = Job(secrets.token_hex(16), b.get("bucket", DEFAULT), json.loads(schema.to_json()), size, b.get("fingerprint", ""))
        self.uploads.mkdir(parents=True, exist_ok=True)
        (self.uploads / f"{job.id}.csv").touch()
        self.jobs[job.id] = job
        return asdict(job)

    def _job(self, method: str, job_id: str, action: str, headers: dict[str, str], body: bytes) -> dict:
        job = self.jobs.get(job_id)
        if job is None:
            raise NotFound(f"import job {job_id}")
        if (method, action) == ("GET", ""):
            return asdict(job)
        if job.stage != "uploading":
            raise ConflictError(f"the job is {job.stage}")
        path = self.uploads / f"{job.id}.csv"
        if (method, action) == ("PUT", "chunk"):
            offset = int(headers.get("x-upload-offset", -1))
            if offset != job.received:
                raise ConflictError(f"the next chunk starts at {job.received}")
            if not body or len(body) > CHUNK_BYTES or offset + len(body) > job.size:
                raise Refused(413, f"a chunk has 1 to {CHUNK_BYTES} bytes and stays within the announced size")
            with path.open("r+b") as f:
                f.seek(offset)
                f.write(body)
            job.received += len(body)
            return asdict(job)
        if (method, action) == ("POST", "complete"):
            if job.received != job.size:
                raise ConflictError(f"{job.received} of {job.size} bytes were received")
            if job.fingerprint and self._fingerprint(path) != job.fingerprint:
                raise InvalidData("the upload doesn't match its fingerprint")
            job.stage = "queued"
            threading.Thread(target=self._build, args=(job, path), daemon=True).start()
            return asdict(job)
        raise Refused(404, f"no action {method} {action}")

    @staticmethod
    def _fingerprint(path: Path) -> str:
        """SHA-256 of the first MiB."""
        with path.open("rb") as f:
            return hashlib.sha256(f.read(1 << 20)).hexdigest()

    def _build(self, job: Job, path: Path) -> None:
        source, schema = f"file://{os.path.abspath(path)}", Schema.from_json(job.schema)
        try:
            self._run(job, lambda catalog: imports.import_segmented(catalog, source, schema, self.config.part_rows, append=catalog.current() is not None))
        finally:
            with contextlib.suppress(OSError):
                path.unlink()

    def _run(self, job: Job, work: Callable[[Catalog], imports.Report]) -> None:
        """A job's import, when its turn comes."""
        with self.builds:
            job.stage = "importing"
            try:
                r = work(self.buckets.catalog(job.bucket))
                job.rows = r.accepted_rows
                job.stage = "complete"
            except Exception as e:
                job.error = str(e)[:500]
                job.stage = "failed"

    def _expire(self) -> None:
        for job in [j for j in self.jobs.values() if time.time() - j.created > JOB_SECONDS]:
            with contextlib.suppress(OSError):
                (self.uploads / f"{job.id}.csv").unlink()
            del self.jobs[job.id]

    def close(self) -> None:
        shutil.rmtree(self.uploads, ignore_errors=True)
