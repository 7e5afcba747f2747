"""Quality rules against a plain Python version, with awkward rows."""

import re
from collections import Counter

from pyspark.sql import functions as F

from keelson.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    out = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in t), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered))
    out["base_failed"] = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return out


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 500, "the cat sat on the mat and it was fine for all of us in the old house by the sea today",
    "line one here\n\nline one here\n line one here", "#*$% & | <> 𝄞𝄞 é " * 10, "word\x0b\x0cother\r\n" * 30, "\n".join(["same line"] * 9), "ab" * 60_000, " ".join(f"w{i} of the" for i in range(40_000)),
]


def test_measures(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[7], 1), (7, TEXTS[7], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = rules.judge(df).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        want = brute(t)
        for r in by_id[i]:
            assert {k: r[k] for k in want} == want
            assert not (r.base_failed and r.kept)
    assert by_id[7][0].kept and len(by_id[7]) == 2


def test_keep_and_plan(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept int")
    kept = rules.keep(df)
    assert kept.columns == df.columns
    assert 7 in {r.doc_id for r in kept.collect()}
    plan = rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert rules.judge(df.where(F.lit(False))).collect() == []
