"""Substring dedup with fixed-block anchors.

A window is ``window`` consecutive words. With anchors of b = (window + 1) / 2 words at multiples of b in
each document, every window holds exactly one whole anchor of its own document. So a window can
only occur elsewhere if its anchor does, at any offset:

1. anchors are the index, and every rolling run of b words probes it: an anchor hits if its words
   also start somewhere else;
2. hits are extended: the windows around hit anchors are compared as a whole, and those that occur
   twice, laid over each other, are the maximal exact repeats. Their words are removed.

Documents are first put into written chunks of a few MB, each one row. A chunk sends, for each slot of
the hash range, its distinct hashes in sorted order (differences of 32 bits for probes, which are
verified; 64 bits for windows), and gets one bit per anchor or window back. A passage that many
documents share is one hash per chunk and slot, so it has no hot task, and no pairs are formed. Bits
are broadcast up to ``broadcast_bytes`` and joined by chunk beyond that.

Chunk and slot sizes bound a task's memory (about 100 bytes a word of a chunk, 24 a hash of a slot). Both follow the measured size
of the input (``sizes_for``), so that a chunk has at least ``BLOB_HASHES`` hashes for each slot: 4 MB and 3 million hashes up to
some 100 GB, about 50 MB and 30 million at 100 TB. Windows are equal if their 64-bit hashes are, and only windows around hit anchors are
compared: among n of these, n * n / 2 ** 65 pairs are expected to be taken for equal that are not (one at 6 billion).

Defined results: a null or empty text has no words, nothing removed and the hash of the empty
string; documents with fewer words than a window keep all; repeated rows are documents of their
own and so repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import cut

WINDOW = 35
CHUNK_BYTES = 4 << 20
SLOT_ENTRIES = 3_000_000
BLOB_HASHES = 16
BROADCAST_BYTES = 16 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_C = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of several texts that lie one after the other in a buffer.

    ``edges`` are the texts' byte offsets, ``first`` the index of each text's first word.
    """

    def __init__(self, raw: np.ndarray, edges: np.ndarray):
        space = _SPACE[raw]
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = edges[(edges > 0) & (edges < len(raw))]
        before[inner], after[inner - 1] = True, True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(starts, edges)
        self.counts = np.diff(self.first)
        self.hashes = self._hash(raw, starts, ends - starts)
        self.position = np.arange(len(starts)) - np.repeat(self.first[:-1], self.counts)
        self.left = np.repeat(self.counts, self.counts) - self.position

    @staticmethod
    def _hash(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Eight bytes at a time, over all words that are long enough."""
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))
        out, who, at = lengths.astype(np.uint64) * np.uint64(_C[1]), np.arange(len(starts)), 0
        while len(who):
            rest = np.minimum(lengths[who] - at, 8).astype(np.uint64)
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8))
            out[who] = _mix(out[who] * np.uint64(_C[0]) + (eight[starts[who] + at] & keep) + np.uint64(1))
            at += 8
            who = who[lengths[who] > at]
        return out

    def rolling(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word of each run of n words within one text, and the run's hash; by doubling."""
        c, have, width, at = np.uint64(_C[seed]), self.hashes, 1, None
        power = lambda k: np.uint64(pow(int(c), k, 1 << 64))
        total = len(self.hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        size, done = n, 0
        while size:
            if size & 1:
                piece = have[done : done + total - n + 1]
                at = piece.copy() if at is None else at * power(width) + piece
                done += width
            size >>= 1
            if size:
                have = have[:-width] * power(width) + have[width:]
                width *= 2
        whole = np.flatnonzero(self.left[: total - n + 1] >= n)
        return whole, _mix(at[whole])


def _texts(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of column text and its offsets; null texts are empty."""
    column = table.column("text")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """A written table of chunks: chunk (unique), size (bytes of text), payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int64()), "payload": pa.array([_pack(whole)], pa.binary())})

        for batch in batches:
            _, edges = _texts(batch)
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(edges, edges[at] + chunk_bytes - size, side="right")) - 1
                if to <= at and held:  # the next text goes into a chunk of its own if it is longer than one
                    yield flush()
                    held, size = [], 0
                    continue
                to = max(to, at + 1)
                held.append(batch.slice(at, to - at))
                size += int(edges[to] - edges[at])
                at = to
        if held:
            yield flush()

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(plain.mapInArrow(write, "size long, payload binary").withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def sizes_for(size: int) -> tuple[int, int]:
    """Bytes of a chunk and hashes of a slot for so many bytes of text: a chunk of c words and slots of e hashes among w words in all make
    blobs of c * e / w hashes, and take 100 c and 24 e bytes of memory; the least of both at ``BLOB_HASHES`` a blob."""
    words = size / 6
    entries = max(SLOT_ENTRIES, int((100 / 24 * BLOB_HASHES * words) ** 0.5))
    return max(CHUNK_BYTES, int(6 * BLOB_HASHES * words / entries)), entries


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Edges of the slots in a sorted array of hashes: equal parts of the hash range."""
    bounds = np.array([(s << 64) // slots for s in range(1, slots)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them occur more than once."""
    ordered = np.sort(hashes)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return ordered[at], np.diff(np.concatenate([at, [len(ordered)]])) > 1


_LOW = np.uint64(16)  # probes leave out so many low bits


def _shrink(hashes: np.ndarray) -> bytes:
    """Sorted 48-bit values as a first value and 32-bit differences; as they are where one is too large."""
    gaps = np.diff(hashes)
    if len(gaps) and gaps.max() >= 1 << 32:
        return b"\1" + hashes.tobytes()
    return b"\0" + hashes[:1].tobytes() + gaps.astype(np.uint32).tobytes()


def _grow(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\1":
        return np.frombuffer(raw, np.uint64, offset=1)
    first, gaps = np.frombuffer(raw, np.uint64, 1, 1), np.frombuffer(raw, np.uint32, offset=9)
    return np.concatenate([first, first + np.cumsum(gaps, dtype=np.uint64)])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)


_SENT = "slot int, chunk long, hashes binary, twice binary, asked binary"
_ANSWER = "chunk long, slot int, bits binary"


def _send(chunk: int, values: np.ndarray, twice: np.ndarray, asked: np.ndarray, edges: np.ndarray) -> pd.DataFrame:
    rows = []
    for slot in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[slot], edges[slot + 1])
        rows.append((slot, chunk, _shrink(values[part]), _bits(twice[part]), _bits(asked[part])))
    return pd.DataFrame(rows, columns=["slot", "chunk", "hashes", "twice", "asked"])


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, which of the hashes that it asks about occur twice: in itself or in two chunks."""
    sets = [_grow(raw) for raw in pdf["hashes"]]
    every = np.sort(np.concatenate(sets))
    common = np.unique(every[1:][every[1:] == every[:-1]])
    rows = []
    for chunk, slot, values, twice, asked in zip(pdf["chunk"], pdf["slot"], sets, pdf["twice"], pdf["asked"], strict=True):
        wanted = _flags(asked, len(values))
        found = _flags(twice, len(values))[wanted]
        if len(common):
            mine = values[wanted]
            at = np.minimum(np.searchsorted(common, mine), len(common) - 1)
            found |= common[at] == mine
        rows.append((chunk, slot, _bits(found)))
    return pd.DataFrame(rows, columns=["chunk", "slot", "bits"])


class _Anchors:
    """The probes of a chunk and, once their bits are known, the windows around hit anchors."""

    def __init__(self, words: Words, window: int, slots: int):
        self.words, self.window, self.size = words, window, (window + 1) // 2
        at, hashes = words.rolling(self.size)
        self.values, self.twice = _distinct(hashes >> _LOW)
        self.edges = _slots(self.values << _LOW, slots)
        own = words.position[at] % self.size == 0
        self.anchor_at = at[own]
        self.anchor = np.searchsorted(self.values, hashes[own] >> _LOW)
        self.asked = np.zeros(len(self.values), bool)
        self.asked[self.anchor] = True

    def windows(self, answers: dict[int, bytes], slots: int) -> "_Windows":
        hit = np.zeros(len(self.values), bool)
        for slot, raw in answers.items():
            part = slice(self.edges[slot], self.edges[slot + 1])
            asked = self.asked[part]
            hit[part][asked] = _flags(raw, int(asked.sum()))
        starts = self.anchor_at[hit[self.anchor]]
        near = (starts[:, None] - np.arange(self.size)[None, :]).ravel()
        back = np.repeat(self.words.position[starts], self.size) if len(starts) else np.zeros(0, np.int64)
        near = near[back >= np.tile(np.arange(self.size), len(starts))]
        near = np.sort(near[self.words.left[near] >= self.window])
        return _Windows(self.words, near, self.window, slots)


class _Windows:
    def __init__(self, words: Words, starts: np.ndarray, window: int, slots: int):
        self.words, self.starts, self.window = words, starts, window
        at, hashes = words.rolling(window, 1)
        self.hashes = hashes[np.searchsorted(at, starts)]
        self.values, self.twice = _distinct(self.hashes)
        self.edges = _slots(self.values, slots)

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each word, whether a window that occurs elsewhere covers it."""
        again = np.zeros(len(self.values), bool)
        for slot, raw in answers.items():
            first, last = self.edges[slot], self.edges[slot + 1]
            again[first:last] = _flags(raw, int(last - first))
        starts = self.starts[again[np.searchsorted(self.values, self.hashes)]]
        steps = np.zeros(len(self.words.hashes) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + self.window, -1)
        return np.cumsum(steps)[:-1] > 0


def _with_answers(chunks: DataFrame, answers: list[DataFrame], broadcast_bytes: int) -> DataFrame:
    """Chunks with one list of (slot, bits) for each table of answers."""
    for n, answer in enumerate(answers):
        size = answer.agg(F.sum(F.length("bits") + 24)).first()[0] or 0
        packed = answer.groupBy("chunk").agg(F.collect_list(F.struct("slot", "bits")).alias(f"answer{n}"))
        chunks = chunks.join(F.broadcast(packed) if size <= broadcast_bytes else packed, "chunk", "left")
    return chunks


def _answer(rows) -> dict[int, bytes]:
    return {r["slot"]: bytes(r["bits"]) for r in rows} if rows is not None else {}


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int | None = None,
    slot_entries: int | None = None, broadcast_bytes: int = BROADCAST_BYTES, with_text: bool = False,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 [, kept_text]."""
    if window < 3 or window % 2 == 0:
        raise ValueError("window must be odd and at least 3")
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    best = sizes_for(size)
    chunk_bytes, slot_entries = chunk_bytes or best[0], slot_entries or best[1]
    chunks = chunked(docs, id_col, text_col, chunk_bytes)
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / 6 / slot_entries) + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                a = _Anchors(Words(*_texts(_unpack(payload.as_buffer()))), window, slots)
                yield pa.RecordBatch.from_pandas(_send(chunk, a.values, a.twice, a.asked, a.edges), schema=sent, preserve_index=False)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, answer in zip(batch.column("chunk").to_pylist(), batch.column("payload"), batch.column("answer0"), strict=True):
                a = _Anchors(Words(*_texts(_unpack(payload.as_buffer()))), window, slots)
                w = a.windows(_answer(answer.as_py()), slots)
                yield pa.RecordBatch.from_pandas(_send(chunk, w.values, w.twice, np.ones(len(w.values), bool), w.edges), schema=sent, preserve_index=False)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, first, second in zip(batch.column("payload"), batch.column("answer0"), batch.column("answer1"), strict=True):
                part = _unpack(payload.as_buffer())
                raw, edges = _texts(part)
                words = Words(raw, edges)
                w = _Anchors(words, window, slots).windows(_answer(first.as_py()), slots)
                gone = w.removed(_answer(second.as_py()))
                lost = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), words.first[:-1]) if len(words.counts) else np.zeros(0, np.int64)
                lost[words.counts == 0] = 0
                kept = []
                for i in range(part.num_rows):
                    mine = raw[edges[i] : edges[i + 1]].tobytes().split()
                    if lost[i]:
                        flags = gone[words.first[i] : words.first[i + 1]].tolist()
                        mine = [x for x, out in zip(mine, flags, strict=True) if not out]
                    kept.append(b" ".join(mine))
                out = {"id": part.column("id"), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
                if with_text:
                    out["kept_text"] = [k.decode("utf-8", "replace") for k in kept]
                yield pa.RecordBatch.from_pydict(out)

    sent = pa.schema([("slot", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary()), ("asked", pa.binary())])
    hits = cut(chunks.select("chunk", "payload").mapInArrow(probe, _SENT).groupBy("slot").applyInPandas(_meet, _ANSWER), "anchor-hits")
    found = _with_answers(chunks.select("chunk", "payload"), [hits], broadcast_bytes)
    repeats = cut(found.mapInArrow(extend, _SENT).groupBy("slot").applyInPandas(_meet, _ANSWER), "window-hits")
    both = _with_answers(chunks.select("chunk", "payload"), [hits, repeats], broadcast_bytes)
    schema = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = both.select("payload", "answer0", "answer1").mapInArrow(finish, schema)
    return out.withColumnRenamed("id", id_col)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i FROM win WHERE s IN (SELECT s FROM dup)),
gone AS (SELECT r, list(DISTINCT i + k) AS p FROM hit, range(0, 35) AS t(k) GROUP BY r),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
lost AS (SELECT DISTINCT r, unnest(p) AS i FROM gone),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN lost ON word.r = lost.r AND word.i = lost.i GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""
