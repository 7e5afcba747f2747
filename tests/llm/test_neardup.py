"""Near-duplicates against exact pairwise similarity."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import neardup
from keelson.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    """component of every (doc_id, text); rows of one doc_id are one document."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), (find(d) if s else d) if d is not None else None) for d, s in sets]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(8):
        text = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(copy) if rng.random() < 0.7 else "\n".join(copy).upper()))
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, "lean " * 9000), (1006, "lean lean lean"), (None, rows[0][1]), rows[1], (1007, " ".join(rng.choices(vocabulary, k=30_000)))]
    return rows


@pytest.mark.parametrize("seed,k,percent,block", [(0, 3, 85, 10**6), (1, 5, 80, 10**6), (2, 3, 85, 150)])
def test_against_brute_force(spark, seed, k, percent, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"cls": F.lit(1), "bands": F.lit(2), "rid": F.lit(3)})
    got = neardup.near_duplicates(df, k, percent, block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(brute(rows, k, percent), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (5, text, "a"), (9, text + " more", "b"), (11, None, "c"), (12, "other", "d"), (None, "free", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
    assert neardup.keep_one(df.where("false")).collect() == []


def test_chain_components(spark):
    n = 400
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1002, 1001), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 800, dtype=np.uint64))
    for share in (0.3, 0.6, 0.9):
        b = np.concatenate([a[: int(len(a) * share)], rng.integers(0, 2**63, 300, dtype=np.uint64)])
        both = int(len(a) * share)
        want = both / (len(a) + len(b) - both)
        regs = neardup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1024)
        assert abs(neardup.similarity(regs[0], regs[1:2], len(a), np.array([len(b)]))[0] - want) < 0.07
        merged = neardup.registers(np.union1d(a, b), np.array([0, len(np.union1d(a, b))]), 1024)
        assert (merged[0] == np.maximum(regs[0], regs[1])).all()


def test_bands_miss_almost_nothing():
    for t in (0.8, 0.85):
        assert (1 - t**neardup.ROWS) ** neardup.bands_for(t) < neardup.MISS
