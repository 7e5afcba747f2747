"""Decontamination against a plain Python version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from keelson.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width):
    windows = {}
    for item, t in items:
        w = words(t)
        if item is None or t is None or not w:
            continue
        n = min(width, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                owners = windows.get(tuple(w[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    found |= owners
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bad))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdÉßx1") for _ in range(rng.randint(1, 4))) for _ in range(25)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for i in range(12)]
    items += [(50, None), (None, "a b"), (51, ""), (52, "!!"), (3, items[0][1]), (10, items[0][1])]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.4:
                parts += (rng.choice(items)[1] or "").upper().split(" ")
            else:
                parts += rng.choices([*vocabulary, "other", "zz"], k=rng.randint(1, 15))
        docs.append((d, rng.choice([" ", "--", "\n"]).join(parts)))
    docs += [(90, None), (91, ""), (92, "?!"), (None, docs[3][1]), (3, docs[3][1]), (93, " ".join(rng.choices(vocabulary, k=30_000))), (94, "y" * 200_000)]
    return docs, items


@pytest.mark.parametrize("seed,block", [(0, 10**7), (1, 10**7), (2, 40)])
def test_against_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"spans": F.lit(1), "items": F.lit("x"), "rid": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(df, bench, 4, block)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.digest(decontaminate.contamination(docs, none)).collect()
    assert [tuple(x) for x in r] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontaminate.contamination(docs.where("false"), none).collect() == []
    assert decontaminate.clean(docs, none).collect() == docs.collect()


def test_clean(spark):
    phrase = "alpha beta gamma delta"
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, f"Start {phrase.upper()}, end", 5), (2, f"{long} {phrase}! {long}", 6), (3, long, 7), (4, None, 8), (None, phrase, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = decontaminate.clean(df, spark.createDataFrame([("q", phrase)], "item_id string, text string"), 4)
    assert out.columns == df.columns
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert got == {2: (2, f"{long} ! {long}", 6), 3: rows[2], 4: rows[3]}


def brute_clean(docs, items, width):
    windows = {tuple(w[i : i + min(width, len(w))]) for _, t in items if (w := words(t)) for i in range(len(w) - min(width, len(w)) + 1)}
    out = []
    for d, t in docs:
        spans = [m.span() for m in WORD.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
        w = words(t)
        hit = {k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if hit and 20 * len(hit) >= len(w):
            continue
        kept, last = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                kept.append(t[last : spans[k][0]])
            last = spans[k][1]
        out.append((d, "".join([*kept, t[last:]]) if hit else t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 40, 10**7])
def test_clean_by_blocks(spark, block):
    """Blocks of the benchmark are judged together, on the text as it was."""
    rng = random.Random(5)
    docs, items = corpus(5)
    items = [x for x in items if len(words(x[1])) >= 3 or not words(x[1])]
    fill = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    one, two = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    items += [(100, one), (101, two), (102, "p28 p29 z0 z1 z2 z3")]
    docs += [(200, f"{fill(470)} {one} {fill(470)} {two}"), (201, f"{fill(900)} {one}. {fill(900)}, {two}"), (202, f"{fill(900)} {one} z0 z1 z2 z3 {fill(30)}")]
    docs += [(300 + i, f"{fill(400)}, {rng.choice(items)[1]}; {fill(300)} {t} {fill(400)}") for i, (_, t) in enumerate(items)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_hits", F.lit(1)).repartition(3)
    out = decontaminate.clean(df, spark.createDataFrame(items, "item_id long, text string"), 4, block)
    assert out.columns == df.columns
    want = brute_clean(docs, items, 4)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want
    kept = dict(want)
    assert 200 not in kept and kept[201] != docs[-len(items) - 2][1] and "z" not in kept[202]
