"""Secret scans and the whole pipeline against plain Python, over every document of the smallest tables and awkward rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute_clean
from test_neardup import brute as brute_components
from test_rules import WORD
from test_rules import brute as measures

from keelson.llm import rules, secret_scan

pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

# Contexts are judged by the ASCII classes that the JVM's patterns have.
SECRET, HARMLESS, FIXTURE = (re.compile(p, re.ASCII) for p in (secret_scan._SECRET, secret_scan._HARMLESS, secret_scan._FIXTURE))
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha le ou de me ve co ro ri ca ta".split()
KEY = hashlib.sha1(b"planted").hexdigest()


def uncovered(candidate):
    """Characters that no dictionary word covers, taking the longest word at each place."""
    c, left, i = candidate.lower(), 0, 0
    words, longest = set(secret_scan.DICTIONARY), max(map(len, secret_scan.DICTIONARY))
    while i < len(c):
        n = next((n for n in range(longest, 0, -1) if c[i : i + n] in words), 0)
        left += not n
        i += n or 1
    return left


def kind(ch):
    return "a" if "a" <= ch <= "z" else "A" if "A" <= ch <= "Z" else "0" if ch.isdigit() else ""


def brute_features(c, left, right, path):
    n, low, near = float(len(c)), c.lower(), left[-24:]
    share = lambda hits: sum(hits) / n
    both = list(zip(low, low[1:]))
    return {
        "length": n,
        "transitions": share(kind(a) != "" and kind(a) != kind(b) for a, b in zip(c, c[1:])),
        "digits": share(ch.isdigit() for ch in c),
        "upper": share("A" <= ch <= "Z" for ch in c),
        "letter_pairs": share(a + b in PAIRS for a, b in both),
        "vowel_steps": share(a in "aeiou" and b.isalpha() and b not in "aeiou" for a, b in both),
        "distinct": len(set(c)) / n,
        "not_hex": share(ch not in "0123456789abcdef" for ch in low),
        "separators": share(ch in "-_/=+" for ch in c),
        "dictionary": 1 - uncovered(c) / n,
        "secret_word": float(bool(SECRET.search(near))),
        "secret_inside": float(bool(SECRET.search(c))),
        "harmless_word": float(bool(HARMLESS.search(near))),
        "assigned": float(bool(re.search(r"[=:]\s*[\"']?\Z", left, re.ASCII))),
        "quoted": float(left[-1:] in ('"', "'") and left != "" and right[:1] in ('"', "'") and right != ""),
        "fixture_path": float(bool(FIXTURE.search(path))),
    }


def vote(forest, values, n):
    while forest.feature[n] >= 0:
        n = (forest.low if values[forest.feature[n]] <= forest.bound[n] else forest.high)[n]
    return forest.bound[n]


def brute_findings(text, path, forest):
    """(start, end, score) of every candidate; what lies around it ends at its neighbours, of which the one before is part."""
    text, path = text or "", path or ""
    hits = [m.span() for m in re.finditer(secret_scan.CANDIDATE, text)]
    for i, (a, b) in enumerate(hits):
        left = text[max(a - secret_scan.CONTEXT, hits[i - 1][0] if i else 0) : a]
        right = text[b : min([b + secret_scan.CONTEXT, *(h[0] for h in hits[i + 1 : i + 2])])]
        f = brute_features(text[a:b], left, right, path)
        values, total = [f[name] for name in secret_scan.NAMES], 0.0
        for root in forest.roots:
            total += vote(forest, values, root)
        yield a, b, total / len(forest.roots)


def brute_keep(text):
    m = measures(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    stop = set(" ".join(rules.STOP_WORDS).split())
    of = {**m, "n_lines": lines, "n_stop": sum(w in stop for w in WORD.findall((text or "").lower()))}
    for r in rules.THRESHOLDS:
        value, base = of[r.numerator], 1 if r.denominator is None else of[r.denominator]
        if (r.low is not None and value < r.low * base) or (r.high is not None and value > r.high * base):
            return False
    return not m["base_failed"]


def brute_redact(text, path, forest):
    out, last = [], 0
    for a, b, score in brute_findings(text, path, forest):
        if score >= secret_scan.THRESHOLD:
            out += [text[last:a], secret_scan.MARK]
            last = b
    return "".join([*out, text[last:]])


@pytest.fixture(scope="module")
def tables(spark, data, tmp_path_factory):
    """A folder with all documents of the smallest tables and planted ones, and their benchmark."""
    folder = str(tmp_path_factory.mktemp("brute"))
    given = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    item = max((r.text for r in bench.collect()), key=lambda t: len(t or ""))
    some = [r.text for r in given.where("length(text) > 600").orderBy("doc_id").limit(6).collect()]
    prose = [r.text for r in given.where("lang = 'en' AND length(text) > 900").orderBy("doc_id").limit(16).collect()]
    planted = [
        (10**6, None), (10**6 + 1, ""), (10**6 + 2, some[0]), (10**6 + 2, some[0]), (10**6 + 3, some[1] + " one more"), (10**6 + 4, f"{item} {some[2][:300]}"),
        (10**6 + 5, f'{some[3]}\npassword = "{KEY}" and\n{some[4]}'), (10**6 + 6, f"{KEY}{'=' * 3}{KEY}-_/ {some[5]} token:{KEY}"), (10**6 + 7, " ".join(some) * 30), (10**6 + 8, "x" * 300_000),
        (10**6 + 9, f"commit {KEY} é𝄞 secret='{KEY[:20].upper()}' {' '.join(some[:3])}"),
        (10**6 + 10, f"{' '.join(prose[:8])} {' '.join(item.split()[:15])}, {' '.join(prose[8:])} api_key = \"{KEY}\" {prose[0]}"),
    ]
    rows = [(d, t, "en", "tests/a.py" if d % 2 else None, len(t or "")) for d, t in planted]
    extra = {"kept": F.lit(1), "rid": F.lit(2), "_hits": F.lit("x"), "spans": F.lit(0)}
    given.unionByName(spark.createDataFrame(rows, given.schema)).withColumns(extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, tables):
    return [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_scan(spark, tables, docs):
    forest = secret_scan.default_forest(spark)
    got = secret_scan.scan(spark.read.parquet(f"{tables}/documents.parquet")).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, a, b - a, digest(t[a:b]), s, s >= secret_scan.THRESHOLD) for d, t, p in docs for a, b, s in brute_findings(t, p, forest)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[5] for w in want} == {True, False}


def test_pipeline(spark, tables, docs):
    import corpus_pipeline as pipeline

    forest = secret_scan.default_forest(spark)
    good = [(d, t, p) for d, t, p in docs if brute_keep(t)]
    source = {d: p for d, _, p in good}
    rows = sorted({(d, t) for d, t, _ in good})
    one = [row for row, (d, _, c) in zip(rows, brute_components(rows, 5, 80)) if c == d]
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    cut = brute_clean(one, items, 13)
    path = public.path("byte_bpe_multi_50k.tiktoken")
    from keelson.llm import bpe

    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.tokenizer(path, public.PATTERN).ranks, special_tokens={})
    want = {}
    for d, t in cut:
        text = brute_redact(t, source[d], forest)
        ids = other.encode_ordinary(text)
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = pipeline.run(spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    # every stage has had something to do
    assert len(docs) > len(good) > len(one) > len(cut) and dict(cut) != {d: dict(one)[d] for d, _ in cut}
    assert any(brute_redact(t, source[d], forest) != t for d, t in cut)
