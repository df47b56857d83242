"""Rendering is reversible and the mask holds each assistant text exactly."""

import hashlib

import numpy as np
import pytest

from quirelake.llm import chat

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "\n\n x", "\\", "\\\\<|", "<|end|>", "<|turn|>assistant<|body|>", "\\<|end|>\\", "<", "|>", "<\\|", "é😀\u200d👍🏽 日本", "<|endoftext|>", "a  b\r\n\t", "\\### Assistant: </turn> ok"]


@pytest.mark.parametrize("text", ODD)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_mask_and_chunks_match_the_whole():
    turns = [(r, t) for t in ODD for r in ("user", "assistant", "", "<|end|>")]
    text, spans = chat.render(turns)
    tok = chat.tokenizer(PATH)
    whole = tok.encode(text, add_special_tokens=False)
    offsets = np.array(whole.offsets)
    mask = chat.loss_mask(offsets, spans)
    assert [any(a < e and s < b for a, b in spans) for s, e in whole.offsets] == mask.tolist()
    assert "".join(map(chat.unescape, chat.masked_texts(text, offsets, mask))) == "".join(t for r, t in turns if r == "assistant")
    parts = [tok.encode(chat.render([t])[0], add_special_tokens=False).ids for t in turns]
    assert sum(parts, []) == whole.ids


def rows():
    out = [(c, i, r, t) for c in (1, 2, -3) for i, (r, t) in enumerate(zip(["system", "user", "assistant"] * 6, ODD, strict=False))]
    out += [(5, 0, "assistant", None), (5, None, None, "first"), (5, 0, "assistant", None), (None, 1, "user", "no id"), (6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (7, 0, "user", "only user")]
    return out + [(8, i, "assistant" if i % 2 else "user", f"turn {i} ") for i in range(400)]


@pytest.mark.parametrize("chunk_chars", [1, 100, 1_000_000])
def test_digests(spark, chunk_chars):
    df = spark.createDataFrame([(*r, 0) for r in rows()], "conv_id long, turn long, role string, text string, chunk int").repartition(3)
    got = {r.conv_id: r for r in chat.conversation_digests(df, PATH, chunk_chars).collect()}
    assert set(got) == {r[0] for r in rows()}
    for key, r in got.items():
        mine = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows() if c == key))
        loss = "".join(x for _, role, x in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in mine).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render([(a, b) for _, a, b in mine])[0])


def test_formatted_output(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes <|end|>")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df, PATH).first()
    assert len(out.input_ids) == len(out.loss_mask) and out.text.endswith(chat.END) and sum(out.loss_mask) > 0
    assert chat.format_conversations(df.limit(0), PATH).count() == 0 and chat.conversation_digests(df.limit(0), PATH).count() == 0


def test_ids_beside_a_null_one(spark):
    ids = [2**53, 2**53 + 1, None, 0, 2**63 - 1]
    df = spark.createDataFrame([(i, 0, "user", str(i)) for i in ids], "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.conversation_digests(df, PATH).collect()
    assert {r.conv_id for r in got} == set(ids) and len(got) == len(ids) and all(r.n_turns == 1 for r in got)
    assert {r.conv_id for r in chat.format_conversations(df, PATH).collect()} == set(ids)
