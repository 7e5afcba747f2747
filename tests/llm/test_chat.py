"""Chat formatting: reversible escapes, masks that are exactly the assistant texts, pieces."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import chat

public = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")

noisy = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "\\l", "<", "[", "ok", " ", "\n", "é", "𝄞"]), st.text(max_size=5)), max_size=8).map(lambda x: "".join(x).encode("utf-8", "ignore").decode())


@settings(max_examples=300, deadline=None)
@given(noisy)
def test_escape_is_reversible_and_clean(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>"]), noisy), max_size=6))
def test_mask_is_the_assistant_texts(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    e = chat.tokenizer(public.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False)
    at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    mask = chat.loss_mask(at[:, 0], at[:, 1], spans)
    got = [chat.unescape(x) for x in chat.masked_text(text, at[:, 0], at[:, 1], mask)]
    assert got == [t for r, t in turns if r == "assistant" and t]


def test_pieces_are_the_whole(spark):
    """However a long conversation is cut between turns, its tokens, offsets and masks are those of one encoding."""
    path = public.path("byte_bpe_50k.json")
    turns = [("assistant" if i % 2 else "user", text) for i, text in enumerate(["", " lead", "tail ", "  ", "\n\n", "it's", "ab" * 40, "\\", "<s>", "é𝄞 ", "123 456", "x"] * 4)]
    text, spans = chat.render(turns)
    e = chat.tokenizer(path).encode(text, add_special_tokens=False)
    at = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
    want = (text, e.ids, at[:, 0].tolist(), at[:, 1].tolist(), chat.loss_mask(at[:, 0], at[:, 1], spans).tolist())
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for size in (1, 7, 60, 300, 10**6):
        rows = chat.format_conversations(df, path, size).orderBy("piece").collect()
        assert (len(rows) == 1) == (size == 10**6)
        base = np.cumsum([0, *[len(r.formatted) for r in rows]]).tolist()
        joined = lambda name, add=False: [x + b * add for r, b in zip(rows, base, strict=False) for x in r[name]]
        assert ("".join(r.formatted for r in rows), joined("ids"), joined("starts", True), joined("ends", True), joined("loss")) == want


def brute(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    return {c: [(x[3], x[5]) for x in sorted(v)] for c, v in out.items()}


@pytest.mark.parametrize("piece", [10, 10**6])
def test_conversations(spark, piece):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "more\\"), (2, 0, None, None), (None, 3, "assistant", "x"), (None, 1, "user", "y")]
    rows += [(3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, None, "user", ""), (4, 0, "assistant", "é𝄞" * 20_000), (5, 0, "assistant", "")]
    rows += [(6, i, "user" if i % 2 else "assistant", f"turn {i} <|im_start|>") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit(9), "loss": F.lit("x")})
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df, public.path("byte_bpe_50k.json"), piece)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        r, said = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(chat.render(turns)[0])
    assert chat.digest(chat.format_conversations(df.where("false"), public.path("byte_bpe_50k.json"))).collect() == []
