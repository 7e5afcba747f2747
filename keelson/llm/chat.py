"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: every turn is ``<|turn|>role<|text|>text<|end|>``.
The three marks are special tokens of the tokenizer, and control strings inside
roles and texts are escaped (reversibly), so a token never crosses a turn's
edge. The rendered text is encoded once, with offsets; the loss mask of the
tokens is the binary-search intersection of the sorted spans of assistant texts
with the sorted token spans.

Turns arrive sorted and are handled as a stream. A conversation longer than
``PIECE_CHARS`` is put out in several pieces, cut between turns, so one that
holds a third of all rows needs no more memory than others. The pieces are
exactly the parts of the whole: a cut lies between two special tokens, which the
tokenizer splits off before anything else, so the tokens, offsets and masks of
the pieces, one after the other, are those of the whole conversation encoded at
once.

Defined results: turns are ordered by (turn, role, text), nulls first; a null
role or text is empty; rows without conv_id form one conversation without id;
repeated rows are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship
from .textkernel import lists, tidy

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PIECE_CHARS, BATCH_CHARS = 200_000, 500_000

# Marks that chat templates in public use treat as control strings, and ours.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CODE = {"<": "\\l", "[": "\\b", "\\": "\\\\"}
_BACK = {v[1]: k for k, v in _CODE.items()}
CONTROL_PATTERN = r"\\|" + "|".join(re.escape(c) for c in CONTROL)
_escape = re.compile(CONTROL_PATTERN)
_unescape = re.compile(r"\\(.)", re.DOTALL)
_parse = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """Without control strings: their first character, and every backslash, becomes a backslash code."""
    return _escape.sub(lambda m: _CODE[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _unescape.sub(lambda m: _BACK[m[1]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(the rendered turns, the spans of assistant texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _parse.findall(rendered)]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, by their sorted spans, lie in one of the sorted text spans."""
    mask = np.zeros(len(starts) + 1, dtype=np.int64)
    if spans and len(starts):
        a, b = np.array(spans, dtype=np.int64).T
        lo = np.searchsorted(ends, a, side="right")
        hi = np.searchsorted(starts, b, side="left")
        some = hi > lo
        np.add.at(mask, lo[some], 1)
        np.add.at(mask, hi[some], -1)
    return np.cumsum(mask)[:-1] > 0


def masked_text(rendered: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The runs of text under the masked tokens; a character cut into several tokens counts once."""
    a, b = starts[mask], ends[mask]
    if not len(a):
        return []
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > reach[:-1]
    i = np.flatnonzero(new)
    return [rendered[x:y] for x, y in zip(a[i].tolist(), reach[np.append(i[1:], len(a)) - 1].tolist(), strict=True)]


_tokenizers: dict = {}


def tokenizer(path: str):
    """The vocabulary of ``path`` with the three marks as special tokens, once for each worker."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = False
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


_PIECES = "conv_id long, piece int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def format_conversations(conversations: DataFrame, path: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, piece, formatted, ids, starts, ends and loss: a row per conversation, or several for a long one.

    Rows of a conversation follow each other in one partition, in order.
    """
    ship(conversations.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)

        held: list[tuple] = []

        def add(conv, piece: int, turns: list[tuple[str, str]]) -> int:
            text, spans = render(turns)
            e = tok.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            held.append((conv, piece, text, np.array(e.ids, dtype=np.int32), at[:, 0], at[:, 1], loss_mask(at[:, 0], at[:, 1], spans)))
            return len(text)

        def flush() -> pa.RecordBatch:
            conv, piece, text, *tokens = zip(*held, strict=True)
            bounds = np.cumsum([0, *map(len, tokens[0])])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            columns = [pa.array(conv, pa.int64()), pa.array(piece, pa.int32()), pa.array(text)] + [lists(np.concatenate(x), bounds, k) for x, k in zip(tokens, kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "piece", "formatted", "ids", "starts", "ends", "loss"])

        turns: list[tuple[str, str]] = []
        conv, piece, size, chars = None, 0, 0, 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and (c != conv or size > piece_chars):
                    chars += add(conv, piece, turns)
                    piece = piece + 1 if c == conv else 0
                    turns, size = [], 0
                    if chars > BATCH_CHARS:
                        yield flush()
                        chars = 0
                conv = c
                turns.append((role or "", text or ""))
                size += len(role or "") + len(text or "")
        if turns:
            add(conv, piece, turns)
            yield flush()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _PIECES)


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its pieces say when they are read back."""
    ship(formatted.sparkSession)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, state = None, None

        def close():
            n, turns, chars, loss, size, tokens, masked = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, masked))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            conv_ids, pieces = (batch.column(k).to_pylist() for k in range(2))
            for i in range(batch.num_rows):
                c, piece, text = conv_ids[i], pieces[i], batch.column(2)[i].as_py()
                if piece == 0:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                starts, ends, mask = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (4, 5, 6))
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for part in masked_text(text, starts, ends, mask):
                    said = unescape(part)
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += len(mask)
                state[6] += int(mask.sum())
            if len(done) > 5000:
                yield out()
                done.clear()
        if state is not None:
            close()
        yield out()

    return formatted.select("conv_id", "piece", "formatted", "ids", "starts", "ends", "loss").mapInArrow(run, schema)
