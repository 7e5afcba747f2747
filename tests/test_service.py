"""The command line and the HTTP service."""

import hashlib
import json
import threading
import time
import urllib.request

import pytest

from keelson.__main__ import parser, run
from keelson.errors import ConflictError, InvalidRequest
from keelson.schema import Column, Schema
from keelson.service.app import Config, Service
from keelson.service.http import server

SCHEMA = Schema((Column("email", normalization="trim_lowercase"), Column("age", "unsigned"), Column("note", "text", True, "none", ("",))))
CSV = "email,age,note\nA@x,1,\nb@x,2,two\nc@x,3,three\n"


@pytest.fixture
def cli(spark, tmp_path):
    (tmp_path / "schema.json").write_text(SCHEMA.to_json())
    (tmp_path / "a.csv").write_text(CSV)
    return lambda *args: run(spark, parser().parse_args([str(tmp_path / "root"), *map(str, args)]))


def test_cli(cli, tmp_path):
    assert cli("import", "csv", tmp_path / "a.csv", "--schema", tmp_path / "schema.json", "--initial", "--index", "email,age")["accepted_rows"] == 3
    with pytest.raises(ConflictError):
        cli("import", "csv", tmp_path / "a.csv", "--schema", tmp_path / "schema.json", "--initial")
    r = cli("query", "email= A@X", "--is-null", "note", "--select", "age")
    assert r["rows"] == [{"row_id": 0, "age": "1"}] and r["stats"]["hits"] == 1
    with pytest.raises(InvalidRequest):
        cli("query", "email")
    (tmp_path / "q.json").write_text('{"filters":[{"op":"range","column":"age","gte":"2"}],"limit":1}')
    assert cli("query-json", tmp_path / "q.json")["next_cursor"] == 1
    assert cli("workload")["query_count"] == 1
    (tmp_path / "m.json").write_text('[{"op":"delete","row_id":0},{"op":"insert","values":{"email":"d","age":"9"}}]')
    assert cli("mutate", tmp_path / "m.json")["inserted_ids"] == [3]
    assert cli("row", 0) is None and cli("row", 3)[0] == ("email", "d")
    assert cli("status")["visible_rows"] == 3 and cli("verify")["generation"] == 2 and cli("seal") > 0
    assert cli("compact") == 3 and cli("generations", "list") == [1, 2, 3] and cli("generations", "vacuum", "--retain", 1) == [1, 2]
    assert cli("indexes", "list")[-1]["columns"] == ["age", "email"] and cli("explain", "email=d")["route"] == "equality"
    assert cli("backup", tmp_path / "copy") == 3 and cli("restore", tmp_path / "copy") == 4
    cli("buckets", "create", "two")
    assert cli("buckets", "transfer", "default", "two", 1)["rows"] == 1 and [b[0] for b in cli("buckets", "list")] == ["default", "two"]
    cli("export", tmp_path / "out", "--format", "jsonl", "--request", tmp_path / "q.json")
    assert sum(1 for f in (tmp_path / "out").glob("*.txt") for _ in f.open()) == 3
    assert cli("stats")["cardinalities"]["email"] == 3 and cli("recover") == 4


@pytest.fixture
def service(spark, tmp_path):
    keys = [{"id": r, "token": f"t-{r}", "role": r} for r in ("read", "write", "admin")]
    return Service(spark, Config(str(tmp_path / "root"), keys, rate_per_minute=60))


def call(service, method, path, body=None, role="admin", raw=None, headers=None):
    data = raw if raw is not None else json.dumps(body).encode() if body is not None else b""
    return service.handle(method, path, {"authorization": f"Bearer t-{role}"} | (headers or {}), data)


def upload(service, text, **more):
    data = text.encode()
    body = {"schema": json.loads(SCHEMA.to_json()), "size": len(data), "fingerprint": hashlib.sha256(data).hexdigest()} | more
    status, job = call(service, "POST", "/v1/admin/imports", body)
    assert status == 200, job
    at = f"/v1/admin/imports/{job['id']}"
    assert call(service, "PUT", at + "/chunk", raw=data[:10], headers={"x-upload-offset": "5"})[0] == 409
    assert call(service, "POST", at + "/complete")[0] == 409
    for k in range(0, len(data), 20):
        assert call(service, "PUT", at + "/chunk", raw=data[k : k + 20], headers={"x-upload-offset": str(k)})[0] == 200
        if k == 0:
            assert call(service, "POST", "/v1/admin/imports", body)[1]["received"] == 20  # the same upload goes on
    assert call(service, "POST", at + "/complete")[0] == 200
    for _ in range(600):
        job = call(service, "GET", at)[1]
        if job["stage"] in ("complete", "failed"):
            return job
        time.sleep(0.1)
    raise AssertionError(job)


def test_service(service):
    assert call(service, "GET", "/healthz")[0] == 200 and call(service, "GET", "/readyz")[0] == 503
    service.config.rate_per_minute = 10_000
    assert upload(service, CSV)["rows"] == 3
    assert upload(service, "email,age,note\nx,bad,\n", append=True)["stage"] == "failed"
    assert call(service, "POST", "/v1/admin/imports", {"schema": json.loads(SCHEMA.to_json()), "size": 5})[0] == 409
    assert call(service, "GET", "/readyz")[0] == 200
    query = {"filters": [{"op": "eq", "column": "email", "value": "B@x"}], "limit": 50_000, "timeout_ms": 10**9}
    status, r = call(service, "POST", "/v1/query", query, "read")
    assert status == 200 and r["rows"][0]["values"][1] == {"column": "age", "value": "2"} and r["stats"]["optimized_equality_route"]
    for bad, code in (({"filters": [{"op": "eq", "column": "nope", "value": "x"}]}, 400), ({"filters": [{"op": "eq", "column": "age", "value": "x"}]}, 400), ({"filters": [], "limit": 0}, 400), ({"bucket": "none", "filters": []}, 404)):
        assert call(service, "POST", "/v1/query", bad)[0] == code
    assert call(service, "POST", "/v1/query", raw=b"{nonsense")[0] == 400 and call(service, "GET", "/v1/none")[0] == 404
    assert call(service, "POST", "/v1/mutate", {"mutations": []}, "read")[0] == 403 and service.handle("GET", "/v1/stats", {}, b"")[0] == 401
    assert call(service, "POST", "/v1/mutate", {"mutations": [{"op": "delete", "row_id": 0}]}, "write")[1]["deleted"] == 1
    assert call(service, "POST", "/v1/query", {"filters": []}, "read")[1]["stats"]["hits"] == 2
    assert call(service, "POST", "/v1/row", {"row_id": 0}, "read")[0] == 404 and call(service, "POST", "/v1/row", {"row_id": 1}, "read")[0] == 200
    assert call(service, "POST", "/v1/admin/index/add", {"columns": ["email", "age"]})[0] == 200 and call(service, "POST", "/v1/admin/index/add", {"columns": ["email", "age"]})[0] == 409
    for path in ("/v1/buckets", "/v1/stats", "/v1/schema", "/v1/workload", "/v1/generations", "/v1/indexes", "/metrics"):
        assert call(service, "GET", path, role="read")[0] == 200
    assert call(service, "POST", "/v1/admin/compact", {})[0] == 200 and call(service, "POST", "/v1/admin/vacuum", {"retain": 1})[0] == 200
    service.config.rate_per_minute = 1
    assert {call(service, "GET", "/v1/buckets", role="write")[0] for _ in range(3)} == {429} or service.counters["rate_limited"]


def test_tools_and_small_import(service):
    rpc = lambda method, role="read", **params: call(service, "POST", "/mcp", {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, role)[1]
    assert call(service, "POST", "/v1/admin/import/csv", {"schema": json.loads(SCHEMA.to_json()), "csv": CSV})[1]["accepted_rows"] == 3
    assert call(service, "POST", "/v1/admin/import/csv", {"schema": json.loads(SCHEMA.to_json()), "csv": CSV})[0] == 409
    assert "tools" in rpc("initialize")["result"]["capabilities"]
    names = [{t["name"] for t in rpc("tools/list", role)["result"]["tools"]} for role in ("read", "write", "admin")]
    assert "query" in names[0] and "mutate" in names[1] - names[0] and "compact" in names[2] - names[1]
    found = rpc("tools/call", name="query", arguments={"filters": [{"op": "eq", "column": "age", "value": "2"}]})["result"]
    assert not found["isError"] and json.loads(found["content"][0]["text"])["stats"]["hits"] == 1
    assert rpc("tools/call", name="query", arguments={"filters": [{"op": "eq", "column": "nope", "value": "2"}]})["result"]["isError"]
    assert rpc("tools/call", name="nothing")["error"]["code"] == -32601
    assert call(service, "POST", "/mcp", {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "compact"}}, "read")[0] == 403


def test_http_and_exports(service):
    service.config.rate_per_minute = 10_000
    upload(service, CSV)
    with pytest.raises(ValueError):
        server(service, "0.0.0.0", 0)
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    try:
        body = json.dumps({"filters": [{"op": "range", "column": "age", "gte": "2"}], "select": ["age"], "format": "csv"}).encode()
        link = json.load(urllib.request.urlopen(urllib.request.Request(base + "/v1/export", body, {"Authorization": "Bearer t-read"})))
        assert urllib.request.urlopen(base + link["url"]).read().decode() == "_row_id,age\n1,2\n2,3\n"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + "/exports/none")
        assert e.value.code == 404
    finally:
        http.shutdown()
