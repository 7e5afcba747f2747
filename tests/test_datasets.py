"""Datasets on disk: imports, mutations, appends, compaction, buckets, catalog operations, telemetry, export, attached shards."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from keelson.errors import ConflictError, InvalidData, InvalidRequest, NotFound
from keelson.operators import catalog as catalogs
from keelson.operators import digests, indexes, mutation, telemetry
from keelson.operators.buckets import Buckets
from keelson.operators.catalog import Catalog
from keelson.operators.mutation import Delete, Insert, Update
from keelson.plans import catalogue, lifecycle  # noqa: F401
from keelson.plans.request import Eq, In, Range, Request
from keelson.schema import ROW_ID, Column, Schema
from keelson.sources import attached, export, imports, rows
from keelson.streaming.append import append_batch, append_stream

PEOPLE = Schema((Column("country", normalization="trim_lowercase"), Column("age", "unsigned", normalization="trim"), Column("active", "boolean", normalization="trim_lowercase"), Column("note", "text", True, "trim", ("NULL",))))


def write(path, text):
    path.write_text(text)
    return str(path)


def table(catalog):
    d = catalog.dataset()
    return [(r[0], *[v for _, v in r[1]]) for r in d.query(Request(limit=1000)).rows]


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "set"))


def test_strict_csv(catalog, tmp_path):
    path = write(tmp_path / "a.csv", 'note,active,country,age\n" hi, ""you"" ",TRUE, US ,042\nNULL,0,de,+7\n"two\nlines",1,,5\n')
    r = imports.import_csv(catalog, path, PEOPLE, [["age", "country"]], initial=True)
    assert (r.accepted_rows, r.generation) == (3, 1)
    assert table(catalog) == [(0, "us", "42", "true", 'hi, "you"'), (1, "de", "7", "false", None), (2, "", "5", "true", "two\nlines")]
    with pytest.raises(ConflictError):
        imports.import_csv(catalog, path, PEOPLE, initial=True)
    assert imports.import_csv(catalog, path, PEOPLE).generation == 2


def test_strict_csv_short_rows_widen(catalog, tmp_path):
    imports.import_csv(catalog, write(tmp_path / "a.csv", "country,age,active,note\nus,30\nde,1,0,\n"), PEOPLE)
    assert table(catalog) == [(0, "us", "30", None, None), (1, "de", "1", "false", "")]
    assert [c.nullable for c in catalog.dataset().schema.columns] == [False, False, True, True]


@pytest.mark.parametrize(
    "text",
    ["country,age,active\nus,1,1\n", "country,age,active,note,more\nus,1,1,x,y\n", "country,age,age,note\nus,1,1,x\n", "country,age,active,note\nus,x,1,n\n", "country,age,active,note\nus,1,1,n,extra\n", "country,age,active,note\n", "country,age,active,note\nus,1,maybe,n\n"],
)
def test_failed_import_leaves_current(catalog, tmp_path, text):
    imports.import_csv(catalog, write(tmp_path / "ok.csv", "country,age,active,note\nus,1,1,n\n"), PEOPLE)
    before = (catalog.current(), table(catalog), sorted(catalog.store.list("data")))
    with pytest.raises(InvalidData):
        imports.import_csv(catalog, write(tmp_path / "bad.csv", text), PEOPLE)
    assert (catalog.current(), table(catalog), sorted(catalog.store.list("data"))) == before
    assert not catalog.store.exists("LOCK")


def test_tolerant_csv_and_rejects(catalog, tmp_path):
    path = write(tmp_path / "a.csv", "x,country,age,active,note\n1,us,3,1,NULL\n2,de,bad,1,n\n3,fr,4,0\n4,it,5,,n\n")
    with pytest.raises(InvalidData):
        imports.import_external(catalog, path, PEOPLE, "csv", max_rejects=1)
    r = imports.import_external(catalog, path, PEOPLE, "csv", max_rejects=2, rejects=str(tmp_path / "rejects"))
    assert (r.source_rows, r.accepted_rows, r.rejected_rows) == (4, 2, 2)
    assert table(catalog) == [(0, "us", "3", "true", None), (1, "fr", "4", "false", "")]
    log = sorted((json.loads(x) for f in (tmp_path / "rejects").glob("*.json") for x in f.read_text().splitlines()), key=lambda x: x["row"])
    assert [x["row"] for x in log] == [2, 4] and "bad" in log[0]["raw"]


LINES = """{"country":" US ","age":42,"active":true,"note":"NULL"}

{"country":"de","age":"7","active":"0","note":null}
{"country":"fr","age":8,"active":1}
{"country":"fr","age":1e3,"active":true}
{"country":"fr","age":-1,"active":true}
{"country":null,"age":1,"active":true}
{"age":1,"active":true}
{"country":"x","age":1,"active":true,"other":1}
{"country":"x","age":{"a":1},"active":true}
{"country":"x","age":[1],"active":true}
[1,2]
nonsense
"""


def test_jsonl(catalog, tmp_path):
    r = imports.import_external(catalog, write(tmp_path / "a.jsonl", LINES), PEOPLE, "jsonl", max_rejects=20, rejects=str(tmp_path / "rejects"))
    assert (r.source_rows, r.accepted_rows) == (12, 3)
    assert table(catalog) == [(0, "us", "42", "true", "NULL"), (1, "de", "7", "false", None), (2, "fr", "8", "true", None)]
    assert imports.import_external(catalog, write(tmp_path / "b.jsonl", LINES), PEOPLE, "jsonl", max_rejects=20, unknown=True).accepted_rows == 4


def test_json_array(catalog, tmp_path):
    r = imports.import_external(catalog, write(tmp_path / "a.json", '[{"country":"A","age":1,"active":true},\n{"country":"b","age":"x","active":false}]'), PEOPLE, "json", max_rejects=1)
    assert r.accepted_rows == 1 and table(catalog) == [(0, "a", "1", "true", None)]
    with pytest.raises(InvalidData):
        imports.import_external(catalog, write(tmp_path / "b.json", '[{"country":"a"},'), PEOPLE, "json", max_rejects=9)
    with pytest.raises(InvalidData):
        imports.import_external(catalog, write(tmp_path / "c.json", "[]"), PEOPLE, "json")


def test_resume(catalog, tmp_path, monkeypatch):
    path = write(tmp_path / "a.jsonl", '{"country":"us","age":1,"active":true}\n')
    with catalog._locked(), pytest.raises(ConflictError):
        imports.import_external(catalog, path, PEOPLE, "jsonl")
    assert imports.import_external(catalog, path, PEOPLE, "jsonl", resume=True).resumed
    assert not imports.import_external(catalog, path, PEOPLE, "jsonl", resume=True).resumed


def test_parquet_shards(spark, catalog, tmp_path):
    schema = Schema((Column("email", normalization="trim_lowercase"), Column("score", "signed"), Column("bio", "text", True)))
    for name, rows in (("b", [("C@x", 3, None), ("d@x", 4, "four")]), ("a", [(" A@x", 1, "one"), ("b@x", 2, "two")])):
        spark.createDataFrame(rows, "email string, score int, bio string").coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / name))
    paths = [str(tmp_path / "b"), str(tmp_path / "a")]
    with pytest.raises(InvalidData):
        imports.import_parquet(catalog, [paths[0], paths[0]], schema)
    with pytest.raises(InvalidData):
        imports.import_parquet(catalog, paths, schema, hot=schema.names)
    with pytest.raises(InvalidData):
        imports.import_parquet(catalog, paths, Schema((Column("email"), Column("score", "signed"))))
    imports.import_parquet(catalog, paths, schema, hot=["score"])
    assert table(catalog) == [(0, "a@x", "1", "one"), (1, "b@x", "2", "two"), (2, "c@x", "3", None), (3, "d@x", "4", "four")]


CONTACTS = Schema((Column("email", normalization="trim_lowercase"), Column("country", normalization="trim_lowercase"), Column("note", "text", True, "trim", ("NULL",))))


@pytest.fixture
def contacts(catalog, tmp_path):
    imports.import_csv(catalog, write(tmp_path / "c.csv", "email,country,note\nA@x,US,one\nB@x,DE,NULL\nC@x,US,three\n"), CONTACTS)
    return catalog


def test_headers_by_file(spark, catalog, tmp_path):
    os.mkdir(tmp_path / "in")
    write(tmp_path / "in" / "1.csv", "a,b\n1,2\n")
    write(tmp_path / "in" / "2.csv", "b,a\n4,3\n")
    write(tmp_path / "in" / "3.csv", '\ufeff"b",a\r\n"6\n6",5\r\n')
    schema = Schema((Column("a"), Column("b")))
    imports.import_csv(catalog, str(tmp_path / "in"), schema)
    assert sorted(r[1:] for r in table(catalog)) == [("1", "2"), ("3", "4"), ("5", "6\n6")]
    assert sorted(r[0] for r in table(catalog)) == [0, 1, 2]
    imports.import_external(catalog, str(tmp_path / "in"), schema, "csv")
    assert sorted(r[1:] for r in table(catalog)) == [("1", "2"), ("3", "4"), ("5", "6\n6")]
    imports.import_csv(catalog, write(tmp_path / "q.csv", '"a\nline",b\n1,2\n'), Schema((Column("a\nline"), Column("b"))))
    assert table(catalog) == [(0, "1", "2")]
    write(tmp_path / "in" / "4.csv", "a,c\n1,2\n")
    with pytest.raises(InvalidData):
        imports.import_csv(catalog, str(tmp_path / "in"), schema)


def test_large_files_are_split_where_no_record_spans_lines(spark, catalog, tmp_path):
    os.mkdir(tmp_path / "in")
    write(tmp_path / "in" / "plain.csv", "a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(900)))
    write(tmp_path / "in" / "spans.csv", "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(900, 1800)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {os.path.basename(f): spans for _, spans, files in rows._groups(spark, str(tmp_path / "in"), None) for f in files}
        assert found == {"plain.csv": False, "spans.csv": True}
        imports.import_csv(catalog, str(tmp_path / "in"), Schema((Column("a", "unsigned"), Column("b"))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = catalog.dataset().frame.orderBy(ROW_ID).collect()
    assert [tuple(r) for r in got] == [(i, i, f'x, "{i}"' if i < 900 else f"x\n{i}") for i in range(1800)]


def test_json_array_in_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rows, "JSON_CHARS", 7)
    values = [{"a": "x" * 40, "n": [1, {"b": "]},"}]}, {}, 12.5, "te,xt", None, [[]]]
    for i, text in enumerate((json.dumps(values), json.dumps(values, indent=2) + "\n ", "[]", " [ 1 ]")):
        got = [json.loads(r[0]) for r in rows._elements(spark, [f"file://{write(tmp_path / f'{i}.json', text)}"]).collect()]
        assert got == json.loads(text)
    for text in ("", "{}", "[1", "[1,]", "[1 2]", "[1] 2", '["a', "[,1]"):
        with pytest.raises(InvalidData):
            rows.json_array(spark, write(tmp_path / "bad.json", text), PEOPLE)


def test_updates_keep_the_scan_parallel(spark, contacts):
    view = contacts._view(contacts.manifest()).repartition(3)
    plan = mutation.patched(view, {0: {"note": "x"}}, CONTACTS)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
    plan = mutation.patched(contacts.dataset().frame, {0: {"note": "x"}}, CONTACTS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_row_id), EqualTo(_row_id,0)" in plan or "In(_row_id" in plan or "EqualTo(_row_id,0)" in plan
    many = {i: {"note": "x"} for i in range(mutation.PUSHED_IDS + 1)}
    assert "LessThanOrEqual(_row_id,1000)" in mutation.patched(contacts.dataset().frame, many, CONTACTS)._jdf.queryExecution().executedPlan().toString()


def test_digests_by_executors(contacts, monkeypatch):
    want = contacts.store.read_json(f"generations/{1:020d}/integrity.json")
    monkeypatch.setattr(digests, "DRIVER_BYTES", -1)
    assert contacts.verify()["files"] == len(want)
    sizes = {f: x["size"] for f, x in want.items()}
    remote = digests._remote(contacts.spark, contacts.store, sorted(sizes), contacts.store.root)
    assert {r["file"]: r["sha256"] for r in remote.collect()} == {f: x["sha256"] for f, x in want.items()}


def test_locks_of_others(contacts, monkeypatch):
    contacts.store.create("LOCK", "someone")
    for work in (lambda: mutation.compact(contacts), contacts.recover):
        with pytest.raises(ConflictError):
            work()
    assert contacts.store.read("LOCK") == "someone"
    monkeypatch.setattr(catalogs, "STALE", -1.0)
    assert contacts.recover() == 1 and not contacts.store.exists("LOCK")
    monkeypatch.setattr(catalogs, "STALE", 600.0)
    monkeypatch.setattr(catalogs, "BEAT", 0.05)
    with contacts._locked():
        first = contacts.store._fs.getFileStatus(contacts.store._p("LOCK")).getModificationTime()
        time.sleep(0.5)
        assert contacts.store._fs.getFileStatus(contacts.store._p("LOCK")).getModificationTime() > first
        contacts.store.delete("LOCK")
        contacts.store.create("LOCK", "another")
    assert contacts.store.read("LOCK") == "another"  # only the owner's own lock goes


def test_batches_survive_vacuum(spark, catalog):
    schema = Schema((Column("a", "unsigned"),))
    frame = lambda *v: spark.createDataFrame([(str(x),) for x in v], "a string")
    append_batch(catalog, frame(1, 2), schema, "s", 0)
    for x in "34":
        mutation.apply(catalog, [Insert({"a": x})])
    catalog.vacuum(retain=1)
    append_batch(catalog, frame(1, 2), schema, "s", 0)
    assert len(table(catalog)) == 4
    append_batch(catalog, frame(1, 2), schema, "other", 0)
    append_batch(catalog, frame(9), schema, "s", 1)
    assert len(table(catalog)) == 7 and catalog.manifest().streams == {"s": 1, "other": 0}


def test_mutations(contacts):
    r = mutation.apply(contacts, [Update(0, {"note": None}), Delete(1), Insert({"email": " D@X", "country": "fr", "note": "NULL"}), Update(0, {"country": "IT"})])
    assert (r.inserted_ids, r.visible_rows) == ([3], 3)
    assert table(contacts) == [(0, "a@x", "it", None), (2, "c@x", "us", "three"), (3, "d@x", "fr", "NULL")]
    mutation.apply(contacts, [Update(3, {"note": "x"}), Update(0, {"note": "again"})])
    mutation.apply(contacts, [Update(3, {"note": "y"})])
    want = [(0, "a@x", "it", "again"), (2, "c@x", "us", "three"), (3, "d@x", "fr", "y")]
    assert table(contacts) == want
    d = contacts.dataset()
    assert d.row(1) is None and d.row(3)[0] == ("email", "d@x")
    assert d.query(Request(filters=(Eq("note", "NULL"),))).stats.hits == 0
    mutation.compact(contacts)
    assert table(contacts) == want and len(contacts.manifest().layers) == 1 and contacts.manifest().max_row_id == 3
    assert mutation.apply(contacts, [Insert({"email": "e", "country": "x"})]).inserted_ids == [4]


@pytest.mark.parametrize(
    "ops,error",
    [
        ([], InvalidRequest), ([Delete(9)], NotFound), ([Update(9, {"note": "x"})], NotFound), ([Update(0, {"nope": "x"})], InvalidRequest), ([Update(0, {"email": None})], InvalidRequest), ([Insert({"email": "x"})], InvalidRequest),
        ([Delete(0), Update(0, {"note": "x"})], InvalidRequest), ([Delete(0), Delete(1), Delete(2)], InvalidData), ([Insert({"email": "x", "country": "y"}), Update(3, {"note": "z"})], NotFound),
    ],
)
def test_bad_mutations(contacts, ops, error):
    before = (contacts.current(), table(contacts))
    with pytest.raises(error):
        mutation.apply(contacts, ops)
    assert (contacts.current(), table(contacts)) == before


def test_idempotent_delete_and_json(contacts):
    ops = mutation.from_json('[{"op":"update","row_id":0,"values":{"note":"x"}},{"op":"delete","row_id":0},{"op":"delete","row_id":0},{"op":"insert","values":{"email":"z","country":"q"}}]')
    r = mutation.apply(contacts, ops)
    assert (r.deleted, r.updated, r.inserted) == (1, 0, 1)
    with pytest.raises(InvalidRequest):
        mutation.from_json('[{"op":"upsert"}]')


def test_append_evolution(contacts, tmp_path):
    more = Schema((Column("email", normalization="trim_lowercase"), Column("score", "unsigned")))
    imports.append_csv(contacts, write(tmp_path / "m.csv", "score,email\n5,E@x\n5,E@x\n"), more)
    assert table(contacts)[3:] == [(3, "e@x", None, None, "5"), (4, "e@x", None, None, "5")]
    d = contacts.dataset()
    assert [c.name for c in d.schema.columns if c.nullable] == ["country", "note", "score"]
    assert d.query(Request(filters=(Eq("score", None),))).stats.hits == 3
    with pytest.raises(InvalidData):
        imports.append_csv(contacts, write(tmp_path / "n.csv", "email\n1\n"), Schema((Column("email", "unsigned"),)))
    plan = d.frame.where(F.col("score") == 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1  # the layer without the column isn't read
    mutation.compact(contacts)
    assert table(contacts)[4] == (4, "e@x", None, None, "5")


def test_segments(catalog, tmp_path):
    schema = Schema((Column("email"), Column("visits", "unsigned")))
    path = write(tmp_path / "a.csv", "email,visits\n" + "".join(f"e{i},{i}\n" for i in range(5)))
    imports.import_segmented(catalog, path, schema, rows_per_part=2)
    assert [x.rows for x in catalog.manifest().layers] == [2, 2, 1]
    imports.import_segmented(catalog, path, schema, rows_per_part=4, append=True)
    assert [r[0] for r in table(catalog)] == list(range(10)) and [x.rows for x in catalog.manifest().layers] == [2, 2, 1, 4, 1]
    assert table(catalog)[7] == (7, "e2", "2")
    assert catalog.verify()["visible_rows"] == 10
    small = Catalog(catalog.spark, str(tmp_path / "small"))
    imports.import_segmented(small, path, schema, bytes_per_part=os.path.getsize(path) // 5 * 2)
    rows = [x.rows for x in small.manifest().layers]
    assert sum(rows) == 5 and max(rows) <= 2


def test_many_segments_are_one_scan(catalog, tmp_path):
    schema = Schema((Column("part"), Column("visits", "unsigned")))
    path = write(tmp_path / "a.csv", "part,visits\n" + "".join(f"e{i % 3},{i}\n" for i in range(9)))
    imports.import_segmented(catalog, path, schema, rows_per_part=2)
    imports.import_segmented(catalog, path, schema, rows_per_part=1, append=True)
    m = catalog.manifest()
    assert [(x.number, x.rows) for x in m.layers] == [*((i, 2) for i in range(4)), (4, 1), *((i, 1) for i in range(5, 14))] and len(m.paths) == 2
    plan = catalog.dataset().frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # of 14 layers
    want = [(i, f"e{i % 9 % 3}", str(i % 9)) for i in range(18)]
    assert table(catalog) == want
    per = {r[0]: r[1] for _, df in catalog.layers(m) for r in df.groupBy("_layer").agg(F.min(ROW_ID)).collect()}
    assert per == {i: 2 * i for i in range(5)} | {i: i + 4 for i in range(5, 14)}
    indexes.add(catalog, ["part", "visits"])
    assert indexes.stats(catalog)["base_rows"] == 2 and indexes.stats(catalog)["cardinalities"] == {"part": 2, "visits": 2}
    found = indexes.explain(catalog.dataset(), Request(filters=(Eq("part", "e1"), Eq("visits", "4"))))["layers"]
    assert [x["layer"] for x in found if x["candidates"]] == [2, 9] and found[4]["indexes"] == ["part+visits"] and found[5]["indexes"] == ["part", "visits"]
    mutation.apply(catalog, [Update(3, {"visits": "70"}), Delete(10)])
    want = [(i, p, "70" if i == 3 else v) for i, p, v in want if i != 10]
    assert table(catalog) == want
    catalog.vacuum(retain=0)
    again = Catalog(catalog.spark, str(tmp_path / "again"))
    catalog.backup(str(tmp_path / "copy"))
    again.restore(str(tmp_path / "copy"))
    assert table(catalog) == table(again) == want and again.verify()["visible_rows"] == 17
    first = again.manifest()
    first.layers[0].rows, first.layers[1].rows = 1, 3
    with pytest.raises(InvalidData):
        again._verify_layers(first)
    first.layers = first.layers[2:]
    with pytest.raises(InvalidData):
        again._verify_layers(first)
    mutation.compact(again)
    assert table(again) == want


def test_many_files_keep_order(spark, catalog, tmp_path):
    os.mkdir(tmp_path / "in")
    for k, n in enumerate((1, 300, 20)):
        write(tmp_path / "in" / f"{k}.csv", "a\n" + "".join(f"{k}-{i}\n" for i in range(n)))
    imports.import_csv(catalog, str(tmp_path / "in"), Schema((Column("a"),)), multiline=False)
    assert [v for _, v in table(catalog)] == [f"{k}-{i}" for k, n in enumerate((1, 300, 20)) for i in range(n)]


def test_cursor_after_mutations(catalog, tmp_path):
    schema = Schema((Column("id", "unsigned"), Column("visits", "unsigned")))
    imports.import_csv(catalog, write(tmp_path / "a.csv", "id,visits\n" + "".join(f"{i},{i % 1000}\n" for i in range(2000))), schema)
    seen, cursor = [], None
    while True:
        p = catalog.dataset().query(Request(filters=(Range("visits", "100", "105"),), limit=5, after_row_id=cursor))
        seen.append([i for i, _ in p.rows])
        assert p.stats.hits == 12 and p.stats.rows_examined == 0
        cursor = p.next_cursor
        if cursor is None:
            break
    assert seen == [[100, 101, 102, 103, 104], [105, 1100, 1101, 1102, 1103], [1104, 1105]]
    mutation.apply(catalog, [Update(100, {"visits": "7"}), Update(106, {"visits": "105"}), Delete(1105), Insert({"id": "5", "visits": "101"})])
    p = catalog.dataset().query(Request(filters=(Range("visits", "100", "105"),)))
    assert p.stats.hits == 12 and {106, 2000} <= {i for i, _ in p.rows}


def test_generations(contacts, tmp_path):
    mutation.apply(contacts, [Delete(0)])
    assert contacts.generations() == [1, 2] and len(table(contacts)) == 2
    with contacts.lease(1) as old:
        mutation.compact(contacts)
        assert contacts.vacuum(retain=1) == [2]
        assert old.frame.count() == 3
    assert contacts.vacuum(retain=1) == [1]
    contacts.backup(str(tmp_path / "copy"))
    mutation.apply(contacts, [Delete(1)])
    contacts.rollback(3)
    assert len(table(contacts)) == 2
    assert contacts.restore(str(tmp_path / "copy")) == 5
    assert contacts.verify()["visible_rows"] == 2
    with pytest.raises(NotFound):
        contacts.rollback(77)
    with contacts._locked(), pytest.raises(ConflictError):
        mutation.compact(contacts)


def test_tamper_and_recover(contacts):
    mutation.apply(contacts, [Delete(0)])
    victim = contacts.store.at(next(iter(contacts.store.files(contacts.manifest().visibility))))
    with open(victim, "r+b") as f:
        f.seek(10)
        f.write(b"\xff\xff")
    with pytest.raises(InvalidData):
        contacts.verify()
    assert contacts.recover() == 1 and len(table(contacts)) == 3
    assert contacts.generations() == [1, 2] or contacts.generations() == [1]


def test_buckets(spark, tmp_path):
    b = Buckets(spark, str(tmp_path / "root"))
    imports.import_csv(b.catalog(), write(tmp_path / "c.csv", "email,country,note\na,us,1\nb,de,2\nc,fr,3\n"), CONTACTS)
    b.create("two", "Zwei")
    with pytest.raises(InvalidRequest):
        b.create("Bad Id")
    with pytest.raises(ConflictError):
        b.create("two")
    assert b.transfer("default", "two", [2, 0]).rows == 2
    assert table(b.catalog("two")) == [(0, "a", "us", "1"), (1, "c", "fr", "3")]
    t = b.transfer("default", "two", [1], move=True)
    assert t.moved and [r[0] for r in table(b.catalog())] == [0, 2] and table(b.catalog("two"))[2] == (2, "b", "de", "2")
    with pytest.raises(InvalidData):
        b.transfer("default", "two", [0, 2], move=True)
    with pytest.raises(NotFound):
        b.transfer("default", "two", [1])
    b.combine(["two", "default"], "all")
    assert [r[:2] for r in table(b.catalog("all"))] == [(0, "a"), (1, "c"), (2, "b"), (3, "a"), (4, "c")]
    b.rename("two", "A two")
    assert b.list() == [("default", "default"), ("two", "A two"), ("all", "all")]
    with b.catalog("all").lease(), pytest.raises(ConflictError):
        b.delete("all")
    b.delete("all")
    with pytest.raises(NotFound):
        b.catalog("all")


def test_indexes_and_explain(contacts):
    with pytest.raises(InvalidData):
        indexes.add(contacts, ["email"])
    indexes.add(contacts, ["email", "country"])
    with pytest.raises(ConflictError):
        indexes.add(contacts, ["country", "email"])
    d = contacts.dataset()
    r = indexes.explain(d, Request(filters=(Eq("email", "a@x"), Eq("country", "us"))))
    assert r["route"] == "equality" and r["layers"][0]["indexes"] == ["country+email"] and "PushedFilters" in r["physical"]
    assert indexes.stats(contacts)["cardinalities"] == {"email": 3, "country": 2, "note": 3}
    indexes.rebuild(contacts, ["country", "email"])
    indexes.drop(contacts, ["email", "country"])
    with pytest.raises(NotFound):
        indexes.drop(contacts, ["email", "country"])


def test_telemetry(contacts):
    d = contacts.dataset()
    for value in ("us", "us", "de"):
        telemetry.query(contacts, d, Request(filters=(Eq("country", value), Eq("email", "a@x"))))
    telemetry.query(contacts, d, Request(filters=(In("country", ("us",)),)))
    r = telemetry.report(contacts)
    assert r["query_count"] == 4 and [s["queries"] for s in r["shapes"]] == [3, 1] and r["recommendations"][0]["columns"] == ["country", "email"]
    t = telemetry.benchmark(d, Request(filters=(Eq("country", "us"),)), iterations=2, warmups=0)
    assert t.hits == 2 and t.min_micros <= t.median_micros <= t.max_micros
    empty = telemetry.overall(telemetry.events(contacts).where("false")).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_percentiles_stay_distributed(spark, data, monkeypatch):
    quantiles = [0.0, 0.3, 0.5, 0.5, 0.99, 1.0]
    for taken in ([7], [3, 1, 2] * 40 + [9], list(range(101)), [5] * 50 + [-4]):
        values = spark.createDataFrame([(v,) for v in taken], "`a.b` bigint").repartition(3)
        assert telemetry.percentiles(values, quantiles) == [telemetry.at_rank(sorted(taken), q) for q in quantiles]
    assert telemetry.percentiles(spark.createDataFrame([(None,), (4,), (None,)], "v bigint"), [0.0, 0.4, 1.0]) == [4, None, None]
    assert telemetry.percentiles(spark.createDataFrame([], "v bigint"), [0.0, 1.0]) == [None, None]
    frame, most = type(spark.range(1)), []
    whole = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (most.append(len(rows := whole(self))), rows)[1])
    assert len(catalogue.QUERIES["benchmark_percentiles"](spark, data).collect()) == 5
    assert max(most) < 100  # of 1,500 orders


def test_dictionary_goes_to_the_rows(spark, data, monkeypatch):
    for name in ("dictionary_encode", "filter_token"):
        plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    values = ["b"] * 30 + [None] * 20 + list("xyzuvw") * 2 + ["a"]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, `v.1` string")
    token = {v: i for i, v in enumerate([None, *sorted({v for v in values if v})])}
    want = [(i, v, token[v]) for i, v in enumerate(values)]
    plain = indexes.encoded(df, "v.1")
    assert sorted((tuple(r) for r in plain.collect()), key=lambda r: r[0]) == want
    monkeypatch.setattr(indexes, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(indexes, "HOT_SHARE", 5)
    dealt = indexes.encoded(df, "v.1")
    assert dealt.columns == plain.columns and sorted((tuple(r) for r in dealt.collect()), key=lambda r: r[0]) == want


def test_export(contacts, tmp_path):
    mutation.apply(contacts, [Update(2, {"note": 'a "q", b'}), Delete(0)])
    d = contacts.dataset()
    assert list(export.stream(d.frame, "csv", d.schema.names, True)) == ["_row_id,email,country,note", "1,b@x,de,", '2,c@x,us,"a ""q"", b"']
    assert list(export.stream(d.frame, "jsonl", ["note", "email"])) == ['{"email":"b@x","note":null}', '{"email":"c@x","note":"a \\"q\\", b"}']
    for kind in ("csv", "jsonl"):
        export.export(d.frame, str(tmp_path / kind), kind, d.schema.names, max_rows=1)
    again = Catalog(contacts.spark, str(tmp_path / "again"))
    imports.import_csv(again, str(tmp_path / "csv"), Schema((*CONTACTS.columns[:2], Column("note", "text", True, "none", ("",)))))
    assert table(again) == [(0, "b@x", "de", None)]
    assert export.safe_name("../a b/ç") == "a_b"


def test_attached(spark, tmp_path):
    for i in range(27):
        spark.createDataFrame([(f"e{i}", None if i % 5 == 0 else f"T'{i}")], "Email string, Title string").coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / f"s{i:02d}"))
    a = attached.Attached(spark, [str(tmp_path / f"s{i:02d}") for i in range(27)])
    assert a.rows == 27
    rows, cursor = a.query(Request(limit=10, after_row_id=3))
    assert [r[ROW_ID] for r in rows] == list(range(4, 14)) and cursor == 13
    assert a.query(Request(limit=3, after_row_id=23))[1] is None
    rows, _ = a.query(Request(filters=(Eq("Title", "T'7"),), select=("Email",)))
    assert [(r[ROW_ID], r["Email"]) for r in rows] == [(7, "e7")]
    assert len(a.query(Request(filters=(In("Title", (None, "T'1")),)))[0]) == 7
    assert len(a.query(Request(filters=(Range("Email", "e2", "e25"),)))[0]) == 7
    ints = [str(tmp_path / f"i{k}") for k in range(2)]
    for k, p in enumerate(ints):
        spark.createDataFrame([(k * 3 + i, i % 2 == 0) for i in range(3)], "n int, even boolean").coalesce(1).write.parquet(p)
    numbers = attached.Attached(spark, ints)
    page = numbers.page(Request(filters=(Eq("n", "4"), Eq("even", "false")), after_row_id=2))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n,4)" in plan and "Not(EqualTo(even,true))" in plan and "/i0" not in plan.split("Location", 1)[1].split("PartitionFilters")[0]
    assert [r["n"] for r in page.collect()] == ["4"]
    for text in ("04", "+4", "x", "99999999999"):
        assert numbers.query(Request(filters=(Eq("n", text),)))[0] == []
    assert a.row(26) == {"Email": "e26", "Title": "T'26"} and a.row(27) is None
    with pytest.raises(InvalidRequest):
        a.query(Request(filters=(Eq("x' OR 1=1", "a"),)))


def test_stream(spark, catalog, tmp_path):
    schema = Schema((Column("a", "unsigned"), Column("b", "text", True)))
    source = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame([(str(10 * k + i), f"x{i}") for i in range(3)], "a string, b string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("a string, b string").parquet(source)
        append_stream(catalog, stream, schema, str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r[0], r[1]) for r in table(catalog)] == [(i, str(10 * (i // 3) + i % 3)) for i in range(6)]
    assert len(catalog.manifest().layers) == 2
