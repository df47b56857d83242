"""Removed words against a plain count of all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quirelake.llm import substring


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def texts(seed):
    draw = np.random.default_rng(seed)
    vocabulary = [f"wörd{i}" for i in range(3000)] + ["x", "a" * 30, "b\x1cc", "é", "exactly8", "ninechars"]
    make = lambda n: " ".join(draw.choice(vocabulary, n))
    shared = [make(n) for n in (34, 35, 36, 40, 53, 80, 200)]
    out = [None, "", " \n\t ", "one", "x " * 300, "x " * 34, "x " * 35]
    for _ in range(60):
        parts = [make(int(draw.integers(0, 60)))]
        for _ in range(int(draw.integers(0, 3))):
            parts += [shared[draw.integers(0, len(shared))], make(int(draw.integers(0, 40)))]
        out.append(draw.choice([" ", "\n", "  \t"]).join(parts))
    out += [out[10]] * 3 + [make(400), make(36)]
    return out


@pytest.mark.parametrize("chunk_bytes,broadcast_bytes", [(1 << 20, 1 << 20), (900, 0), (1, 1 << 20)])
def test_against_all_windows(spark, chunk_bytes, broadcast_bytes):
    all_texts = texts(chunk_bytes)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(all_texts)], "doc_id long, text string, chunk string").repartition(3)
    got = sorted(substring.remove_repeats(df, chunk_bytes=chunk_bytes, broadcast_bytes=broadcast_bytes).collect())
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in got] == plain(all_texts, 35)


def test_short_window_and_text(spark):
    rows = [(None, "a b c d e"), (None, "z a b c y"), (5, "q")]
    got = sorted(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=3, with_text=True).collect(), key=lambda r: r.kept_text)
    assert [(r.doc_id, r.kept_text) for r in got] == [(None, "d e"), (5, "q"), (None, "z y")]


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sizes_follow_the_input():
    assert substring.sizes_for(10**9) == (substring.CHUNK_BYTES, substring.SLOT_ENTRIES)
    for size in (10**6, 10**9, 10**11, 10**12, 10**14):
        chunk, entries = substring.sizes_for(size)
        slots = size / 6 / entries
        assert slots < 1.5 or chunk / 6 / slots >= 0.99 * substring.BLOB_HASHES
        assert chunk / 6 * 100 < 1 << 30 and entries * 24 < 1 << 30


def test_chunks_take_whole_documents_from_several_batches(spark):
    rows = [(i, "w " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        chunks = substring.chunked(df, "doc_id", "text", 2000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = [substring._unpack(bytes(c.payload)).column("id").to_pylist() for c in chunks]
    assert sorted(sum(ids, [])) == list(range(300)) and all(c.size <= 2000 for c in chunks) and len(chunks) < 12
