"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its sorted turn spans are intersected with the
tokens' spans by binary search: a token bears loss if it lies within the text of an assistant turn.

Template, for each turn: ``<|turn|>role<|sep|>text<|end|>``. The three marks are tokens of their own, so no token
crosses a text's edge. Control strings (``<|``, ``</s>``, ``<s>``, ``[INST]``, ``[/INST]``) inside roles and texts get one
``~`` after their first character (those that already have some get one more), which ``unescape`` takes out again.

Rows are dealt by conv_id and sorted by turn, and pass through a task as a stream: a task holds some conversations of about
``BATCH_CHARS`` together, or one longer conversation (about 150 bytes for each of its tokens). Where a conversation may be too long for
that, ``chunk_chars`` renders it in several rows that end between turns; ids, spans within a row and masks are those of one
encoding, as the marks divide it anyway, and what ``digests`` reads back is the same.

Defined results: null role or text: empty; ties of turn are ordered by role, then text, and repeated rows are turns of
their own; rows of null conv_id are one conversation; null turns come first; very long turns are rendered whole. Extra columns are
left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import text_batches

TOKENIZER = "byte_bpe_50k.json"
TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
LOSS_ROLE = "assistant"
#: Characters of conversations that are encoded together.
BATCH_CHARS = 1 << 19

_CONTROL = re.compile(r"([<\[])(~*)(\||/s>|s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])~(~*)(\||/s>|s>|INST\]|/INST\])")
_RENDERED = re.compile(r"<\|turn\|>(.*?)<\|sep\|>(.*?)<\|end\|>", re.DOTALL)

_loaded: dict = {}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1~\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, SEP, END)])
        _loaded[path] = t
    return _loaded[path]


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, np.ndarray]:
    """The text of some turns and the sorted spans [start, end) of its loss-bearing texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SEP}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Whether each token lies within a span; spans are sorted and disjoint."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    k = np.searchsorted(spans[:, 0], starts, "right") - 1
    return (k >= 0) & (ends <= spans[np.maximum(k, 0), 1]) & (ends > starts)


def token_spans(encoding, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans that tile the text: each token from the end of those before it, for white space that offsets leave out."""
    off = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(encoding)).reshape(-1, 2)
    ends = np.maximum.accumulate(off[:, 1]) if len(off) else off[:, 1]
    starts = np.minimum(off[:, 0], np.concatenate([[0], ends[:-1]])) if len(off) else off[:, 0]
    return starts, ends


_SCHEMA = "conv_id long, chunk int, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def formatted(conversations: DataFrame, tokenizer_path: str, loss_role: str = LOSS_ROLE, chunk_chars: int | None = None) -> DataFrame:
    """(conv_id, chunk, text, ids, starts, ends, loss): rendered text, token ids, their spans in code points, loss mask.

    One row (chunk 0) for each conversation; with ``chunk_chars``, rows of about so many characters follow each other in one partition.
    """
    text_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_path)

        def out(chunks):
            drawn = [render(turns, loss_role) for _, _, turns in chunks]
            rows = []
            for (conv, k, _), (text, spans), e in zip(chunks, drawn, t.encode_batch([x[0] for x in drawn], add_special_tokens=False), strict=True):
                starts, ends = token_spans(e, len(text))
                rows.append((conv, k, text, e.ids, starts, ends, loss_mask(starts, ends, spans)))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            names = ["conv_id", "chunk", "text", "ids", "starts", "ends", "loss"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        most = chunk_chars or float("inf")
        chunks, size, now = [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
            for conv, role, text in zip(*cols, strict=True):
                if now is None or now[0] != conv or now[3] > most:
                    if now is not None:
                        chunks.append((now[0], now[1], now[2]))
                        size += now[3]
                        if size > BATCH_CHARS:
                            yield out(chunks)
                            chunks, size = [], 0
                    now = [conv, now[1] + 1 if now is not None and now[0] == conv else 0, [], 0]
                now[2].append((role, text))
                now[3] += len(text) + 32
        if now is not None:
            chunks.append((now[0], now[1], now[2]))
        if chunks:
            yield out(chunks)

    return rows.mapInArrow(encode, _SCHEMA)


def digests(chunks: DataFrame) -> DataFrame:
    """What can be read back from ``formatted``'s rows alone: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(s):
            return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["loss_tokens"])

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        s, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                conv, text = batch.column("conv_id")[k].as_py(), batch.column("text")[k].as_py()
                starts, ends, mask = (np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in ("starts", "ends", "loss"))
                if s is None or s["conv"] != conv or batch.column("chunk")[k].as_py() == 0:
                    if s is not None:
                        done.append(row(s))
                    s = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0, "loss_tokens": 0}
                for m in _RENDERED.finditer(text):
                    s["n"] += 1
                    s["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                at = np.flatnonzero(mask)
                if len(at):
                    first = at[np.flatnonzero(np.diff(at, prepend=-2) > 1)]
                    last = at[np.flatnonzero(np.diff(at, append=at[-1] + 2) > 1)]
                    for a, z in zip(starts[first], ends[last], strict=True):
                        under = unescape(text[a:z])
                        s["loss_n"] += len(under)
                        s["loss"].update(under.encode())
                s["chars"] += len(text)
                s["tokens"] += len(starts)
                s["loss_tokens"] += len(at)
            if len(done) > 1000:
                yield out(done)
                done = []
        if s is not None:
            done.append(row(s))
        if done:
            yield out(done)

    return chunks.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return digests(formatted(rows.unionByName(odd), public_tokenizers.path(TOKENIZER))).drop("n_tokens", "loss_tokens")
