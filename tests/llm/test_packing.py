"""Pieces against the tokenizer on whole texts."""

import os
import zlib

import numpy as np
import pytest

from quirelake.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " \t\n", "The Cat's don't, STOP!! x.y z,, '' 'S it'S we'll.", "Éa İI KÅ ΑΣ. ΑΣ é å̀ ́x fi ſ",
    "<|startoftext|>a <|endoftext|> b<|endoftext|>.", "a b c​d 　 \x1c\x1d \x85 x", "日本語 テキスト😀👍🏽 ½²³ ١٢٣ 12 3.4",
    "word " * 5000, "x" * 5000 + "...", "#$% &*| a|b|c ** ?!", "A.B.C. d... e!! 'tis rock'n'roll '' ,' .'s x's, y's. 'RE",
    "<|ENDOFTEXT|>x. <|endoftext|>A, Été!! É× ÷. é÷, İ. İx, ŞA.. J\u030c. \ufb2a. \ufb2a ª. ß?! ÀÿŸ",
]


def plain(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("cache", [10, 1_000_000])
def test_ids_are_those_of_the_whole_text(cache, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", cache)
    known = packing.WordIds(PATH)
    for _ in range(2):
        for t in TEXTS:
            assert np.frombuffer(known.texts([t])[0], "<u4").tolist() == plain(t)[:-1], t
    assert [np.frombuffer(r, "<u4").tolist() for r in known.texts(TEXTS)] == [plain(t)[:-1] for t in TEXTS]


def test_piece_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 6000]:
        got = packing.piece_lengths(n, 64)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 64 for x in got) and got == sorted(got, reverse=True)


def test_pieces_make_up_the_documents(spark):
    rows = [(i, t, 1.0) for i, t in enumerate(TEXTS)] + [(None, "null id", 1.0), (3, TEXTS[3], 1.0)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length double"), PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in got)
    for i, t in enumerate(TEXTS):
        ids = plain(t)
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        assert sum(r.length for r in mine) == len(ids) * (1 + (i == 3))
        for r in mine:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert bytes(r.raw) == raw and r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(ids)
    assert sum(r.length for r in got if r.doc_id is None) == len(plain("null id"))


def test_empty_table_and_buckets(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH).count() == 0
    packed = packing.pack_documents(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), PATH)
    packing.write_buckets(packed, str(tmp_path / "out"))
    assert {r.bucket for r in spark.read.parquet(str(tmp_path / "out")).select("bucket").collect()} == {2, 1}


def test_ids_beside_a_null_one(spark):
    ids = [2**53 + 1, None, 2**53 + 3, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i, "one two three") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack_documents(df, PATH).collect()} == set(ids)
    named = spark.createDataFrame([("a", "one", 1, b""), (None, "two", 2, b"")], "doc_id string, text string, k int, raw binary")
    assert {r.doc_id for r in packing.pack_documents(named, PATH).collect()} == {"a", None}


def test_a_very_long_text(spark):
    text = "Éa stop. " * 200_000 + "x" * 100_000
    got = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).orderBy("start").collect()
    ids = plain(text)
    assert got[0].doc_tokens == len(ids) and b"".join(bytes(r.raw) for r in got) == np.array(ids, "<u4").tobytes()
