"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keelson.llm import substring, suffixsort

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, width):
    least = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def brute_bytes(rows, width, shared):
    count, owners = Counter(), defaultdict(set)
    for d, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
        for i in range(len(b) - shared + 1):
            owners[b[i : i + shared]].add(d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone.update(range(i, i + width))
        spans = sum(i - 1 not in gone for i in gone)
        both = {j for i in range(len(b) - shared + 1) if len(owners[b[i : i + shared]]) > 1 for j in range(i, i + shared)}
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest(), len(both)))
    return Counter(out)


def corpus(seed, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(words, 3 * words))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.4:
                p = rng.choice(passages).split()
                if rng.random() < 0.5:
                    p[rng.randrange(len(p))] = "edit%d" % rng.randrange(99)
                parts += p
            else:
                parts += rng.choices(vocabulary, k=rng.randint(1, 3 * words))
        rows.append((d, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "lean " * 400), (104, "lean " * 300), (105, "a" * 900), (None, rows[3][1]), (7, rows[7][1]), (7, rows[8][1]), (106, "x" * 5000 + " " + rows[5][1])]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"spans": F.lit(1), "rid": F.lit("x"), "anchor": F.lit(2), "doc": F.lit(3)})

    return make


@pytest.mark.parametrize("seed,block", [(0, 10**6), (1, 60)])
def test_words(frame, seed, block, monkeypatch):
    rows = corpus(seed, 8)
    monkeypatch.setattr(substring.repeats, "__defaults__", (8, 3, 500, block))
    got = substring.dedup(frame(rows), 8, 3).collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 8)


@pytest.mark.parametrize("seed,block", [(0, 10**6), (2, 300)])
def test_bytes(frame, seed, block):
    rows = corpus(seed, 10)
    got = suffixsort.dedup(frame(rows), 40, 8, shared=24, shard_bytes=3000, block_bytes=block, run_bytes=2000).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 40, 24)


def test_empty(frame):
    assert substring.dedup(frame([])).collect() == []
    assert suffixsort.dedup(frame([])).collect() == []


def test_merge_runs():
    rng = random.Random(5)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    merged = list(suffixsort.merge_runs([suffixsort.decode_run(*suffixsort.front_code(r)) for r in runs]))
    assert [k for k, _, _ in merged] == sorted(k for r in runs for k in r)
    before = b""
    for n, (k, h, _) in enumerate(merged):
        if n:
            assert h == suffixsort.common_prefix(before, k, 0)
        before = k
    assert defaultdict(int, Counter(r for _, _, r in merged)) == defaultdict(int, {i: len(r) for i, r in enumerate(runs) if r})
