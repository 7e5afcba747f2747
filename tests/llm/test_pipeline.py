"""The pipeline's stages on small planted documents, and all queries by name."""

import hashlib

import pytest

from keelson.llm import queries

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def prose(seed, n=60):
    words = "the house of and river stone to a green field in that was light bread with morning song over hill".split()
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(words[(x >> 8) % len(words)] + ("" if i % 3 else f"{x % 997}"))
    return " ".join(out)


def test_stages(spark, tmp_path):
    key = hashlib.sha1(b"k").hexdigest()
    item = prose(100, 40)
    docs = [
        (1, prose(1)), (2, prose(1)), (3, prose(1) + " more"), (4, prose(4)), (5, "too short"), (6, None), (7, f'{prose(7)} token = "{key}" {prose(8)}'),
        (8, f"{prose(9, 30)} {item}"), (9, f"{prose(10, 1500)} {' '.join(item.split()[:15])} {prose(11, 40)}"), (10, "### $$$ " * 40),
    ]
    rows = [(d, t, "en", "src0", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs_df = stage(spark, docs_df, str(tmp_path))
        if k < 4:
            assert docs_df.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs_df.write.parquet(f"{tmp_path}/{name}")
        docs_df = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(r.doc_id for r in docs_df.select("doc_id").collect()))
    assert kept == [[1, 2, 3, 4, 7, 8, 9], [1, 4, 7, 8, 9], [1, 4, 7, 9], [1, 4, 7, 9], [1, 4, 7, 9]]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/secret_scans").collect()}
    assert key not in texts[7].text and texts[7].text.startswith(prose(7)) and texts[7].n_chars == len(texts[7].text)
    assert " ".join(item.split()[:13]) not in texts[9].text and texts[9].text.startswith(prose(10, 1500))
    whole = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in whole} == {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in texts.items()}


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    """Every query that SQL expresses, over whole tables."""
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = queries.queries()[name](spark, data)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
