"""Secret scans: held-out accuracy, places, redaction, and a native plan."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from keelson.llm import secret_scan


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.default_forest(spark)


def test_held_out_accuracy(spark, forest):
    held = secret_scan.labelled_findings(spark, 3000, seed=1234)
    f = secret_scan.features(*[F.col(c) for c in ("candidate", "left", "right", "path")])
    scored = held.select("label", secret_scan.score(forest, F.array(*[f[n] for n in secret_scan.NAMES])).alias("s"))
    r = scored.agg(F.avg(((F.col("s") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("right"), F.avg(F.when(F.col("label") == 1, (F.col("s") >= 0.5).cast("double"))).alias("found")).first()
    assert r.right > 0.97 and r.found > 0.97


KEY = hashlib.sha1(b"one").hexdigest()
OTHER = hashlib.sha1(b"two").hexdigest()


def test_places_and_redaction(spark, forest):
    rows = [
        (1, f'é𝄞 some text token = "{KEY}" and api_key: "{OTHER}"', "src/a.py", 1),
        (2, "only thesewordsareverylongbutharmless here " * 3, "src/a.py", 2),
        (3, f"commit {KEY} merged", None, 3), (4, None, None, 4), (5, "", "x", 5), (6, "prose " * 50_000 + f'password = "{KEY}"', "src/b.py", 6),
        (1, f'é𝄞 some text token = "{KEY}" and api_key: "{OTHER}"', "src/a.py", 1), (None, f"secret={OTHER}", "", 7),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    found = secret_scan.scan(df, forest).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        candidate = texts[r.doc_id][r.start : r.start + r.length]
        assert re.fullmatch(secret_scan.CANDIDATE, candidate)
        assert hashlib.sha256(candidate.encode()).hexdigest() == r.candidate_sha256
    secrets = sorted((repr(r.doc_id), texts[r.doc_id][r.start : r.start + r.length]) for r in found if r.is_secret)
    assert secrets == sorted([("1", KEY), ("1", OTHER), ("1", KEY), ("1", OTHER), ("6", KEY), ("None", OTHER)])
    out = secret_scan.redact(df, forest)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == texts[1].replace(KEY, secret_scan.MARK).replace(OTHER, secret_scan.MARK)
    assert got[2] == texts[2] and got[3] == texts[3] and got[4] is None and got[5] == ""
    assert got[6] == texts[6].replace(KEY, secret_scan.MARK) and got[None] == f"secret={secret_scan.MARK}"
    assert secret_scan.scan(df.where("false"), forest).collect() == []
    bare = secret_scan.redact(df.drop("source"), forest)
    assert bare.columns == ["doc_id", "text", "score"]


def test_native(spark, forest):
    df = spark.range(1).selectExpr("id AS doc_id", "'x' AS text", "'y' AS source")
    for out in (secret_scan.scan(df, forest), secret_scan.redact(df, forest)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan
