"""Byte-level BPE against the public library, and exact round trips."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import bpe

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    path = public.path("byte_bpe_multi_50k.tiktoken")
    tok = bpe.tokenizer(path, public.PATTERN)
    return tok, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(pair, text):
    tok, other = pair
    text = text.encode("utf-8", "ignore").decode()
    ids = tok.encode(text)
    assert ids == other.encode_ordinary(text)
    assert tok.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2000 + "x", "abab" * 1500, "\n\n\t", "日本語" * 400, "<|endoftext|>", "é" * 1001])
def test_long_pieces(pair, text):
    tok, other = pair
    assert tok.encode(text) == other.encode_ordinary(text)


def test_small_cache(pair, monkeypatch):
    tok, other = pair
    monkeypatch.setattr(bpe, "CACHED_PIECES", 20)
    fresh = bpe.Tokenizer(tok.ranks, public.PATTERN)
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdef", k=4)) for _ in range(3000))
    assert fresh.encode(text) == other.encode_ordinary(text)


def test_frames(spark, pair):
    tok, _ = pair
    path = public.path("byte_bpe_multi_50k.tiktoken")
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (None, "x"), (1, "Hello wörld"), (4, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.round_trip(df, path, public.PATTERN, ids=True).collect()
    assert len(got) == len(rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = tok.encode(text)
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (len(ids), ids, sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    back = bpe.decode(bpe.encode(df, path, public.PATTERN), path, public.PATTERN).collect()
    assert {(r.doc_id, bytes(r.bytes)) for r in back} == {(d, (t or "").encode()) for d, t in rows}
    assert bpe.round_trip(df.where("false"), path, public.PATTERN).collect() == []
