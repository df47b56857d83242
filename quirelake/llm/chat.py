"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|turn|>role<|body|>text<|end|>`` per turn. The three markers are
special tokens of the tokenizer, so that no token crosses a marker, and texts are escaped so that
none holds ``<|``: a backslash doubles and ``<|`` becomes ``<\\|``. The rendering is encoded once with
offsets; assistant spans and token spans, both sorted, meet by binary search.

Turns of a conversation are read in order as a stream (sorted within a partition), rendered in
chunks that end with a turn. Since markers are atomic, the chunks' tokens put together are the
tokens of the whole conversation, and a conversation of any length needs the memory of one chunk.

Defined results: null role or text counts as empty, ties in ``turn`` are ordered by role and text,
a null turn comes first, repeated rows are turns of their own, rows of a null conversation id form
one conversation, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_READ = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
CHUNK_CHARS = 1_000_000

_TOKENIZERS: dict[str, object] = {}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tokenizer(path: str):
    """A byte-level tokenizer with the markers as special tokens and untrimmed offsets."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer, processors

        found = Tokenizer.from_file(path)
        found.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (TURN, BODY, END)])
        found.post_processor = processors.ByteLevel(trim_offsets=False)
        _TOKENIZERS[path] = found
    return _TOKENIZERS[path]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether it lies in an assistant span: both lists are sorted, so the only
    span that can hold a token is the first one that ends after the token's start."""
    if not spans or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans, np.int64).T
    first = np.searchsorted(ends, offsets[:, 0], side="right")
    inside = first < len(ends)
    first = np.minimum(first, len(ends) - 1)
    return inside & (starts[first] < offsets[:, 1])


def masked_texts(text: str, offsets: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The text under the mask, one string for each run of masked tokens."""
    run_start = run_end = None
    for start, end in offsets[mask].tolist():
        if run_end is not None and start <= run_end:
            run_end = max(run_end, end)
            continue
        if run_end is not None:
            yield text[run_start:run_end]
        run_start, run_end = start, end
    if run_end is not None:
        yield text[run_start:run_end]


class _Digest:
    """What is read back from the formatted chunks of one conversation."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars, self.tokens = key, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, offsets: np.ndarray, mask: np.ndarray) -> None:
        self.chars += len(text)
        self.tokens += len(offsets)
        for role, body in _READ.findall(text):
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
        for piece in masked_texts(text, offsets, mask):
            plain = unescape(piece)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens)


def _chunks(batches: Iterator[pd.DataFrame], path: str, chunk_chars: int):
    """(key, is_last, text, ids, offsets, mask) for each chunk; batches are sorted by key and turn. A null key is a flag
    of its own beside a key of 0: a column of longs with a null would reach pandas as floating point."""
    tok, key, held, size, first = tokenizer(path), None, [], 0, True

    def flush(last: bool):
        text, spans = render(held)
        enc = tok.encode(text, add_special_tokens=False)
        offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
        return key, last, text, enc.ids, offsets, loss_mask(offsets, spans)

    for batch in batches:
        for k, missing, role, text in zip(batch["k"].tolist(), batch["missing"].tolist(), batch["role"], batch["text"], strict=True):
            k = None if missing else int(k)
            if first or k != key:
                if not first:
                    yield flush(True)
                key, held, size, first = k, [], 0, False
            elif size >= chunk_chars:
                yield flush(False)
                held, size = [], 0
            held.append((role, text))
            size += len(text) + len(role)
    if not first:
        yield flush(True)


def _ordered(turns: DataFrame) -> DataFrame:
    plain = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("k"), F.col("conv_id").cast("long").isNull().alias("missing"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return plain.repartition("k", "missing").sortWithinPartitions("k", "missing", "turn", "role", "text").select("k", "missing", "role", "text")


def format_conversations(turns: DataFrame, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The formatted output: conv_id, chunk, text, input_ids, loss_mask, in chunks that end with a turn."""

    def write(batches):
        number, last = 0, True
        for key, ended, text, ids, _, mask in _chunks(batches, tokenizer_path, chunk_chars):
            number, last = (0 if last else number + 1), ended
            yield pd.DataFrame({"conv_id": pd.array([key], "Int64"), "chunk": [number], "text": [text], "input_ids": [ids], "loss_mask": [mask.tolist()]})

    return _ordered(turns).mapInPandas(write, "conv_id long, chunk int, text string, input_ids array<int>, loss_mask array<boolean>")


def conversation_digests(turns: DataFrame, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per conversation, read back from its formatted chunks as they are made."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def frame(rows):
        columns = dict(zip(names, zip(*rows, strict=True), strict=True))
        return pd.DataFrame(columns | {"conv_id": pd.array(columns["conv_id"], "Int64")})

    def digest(batches):
        rows, now = [], None
        for key, ended, text, _, offsets, mask in _chunks(batches, tokenizer_path, chunk_chars):
            now = now or _Digest(key)
            now.add(text, offsets, mask)
            if ended:
                rows.append(now.row())
                now = None
            if len(rows) >= 2000:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    return _ordered(turns).mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
