"""Round trips, and damage that the checksums must find."""

import hashlib
import zlib

import numpy as np
import pytest

from quirelake.llm import flac, media


def payloads():
    draw = np.random.default_rng(0)
    text = ("The river runs under the stone bridge, and Éa ça. " * 90).encode()
    slow = (128 + 60 * np.sin(np.arange(5000) / 40)).astype(np.uint8).tobytes()
    ramp = (np.arange(3000) % 256).astype(np.uint8).tobytes()
    jump = bytes([0, 255] * 700)
    wave = (128 + 100 * np.sin(np.arange(3000) * np.pi / 3)).round().astype(np.uint8).tobytes()
    return [b"", b"a", b"ab", bytes(64), b"\x07" * 5000, text, slow, ramp, jump, wave, draw.integers(0, 256, 4097, dtype=np.uint8).tobytes(), text[:1024], text[:1025], b"x" * 1023 + b"y"]


def crc_plain(raw, poly, width):
    value = 0
    for b in raw:
        value ^= b << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ poly if value >> (width - 1) & 1 else value << 1) & (1 << width) - 1
    return value


def test_checksums():
    raw = np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8)
    starts, sizes = np.array([0, 3, 10, 499, 20]), np.array([500, 7, 0, 1, 300])
    for f, poly, width in ((flac.crc8, 7, 8), (flac.crc16, 0x8005, 16)):
        assert f(raw, starts, sizes).tolist() == [crc_plain(raw[a : a + n].tolist(), poly, width) for a, n in zip(starts, sizes, strict=True)]


@pytest.mark.parametrize("options", [{}, {"max_order": 4}, {"block": 16}, {"block": 4096, "max_order": 0}, {"lpc": ([1900, -930], 10)}, {"lpc": ([1024, 0, 0, 0, 5], 10), "block": 200}, {"linear": 4}, {"linear": 7, "block": 100}, {"linear": 2, "block": 16}])
def test_round_trip(options):
    streams = flac.encode(payloads(), **options)
    for p, d in zip(payloads(), flac.decode(streams), strict=True):
        assert d.ok and (d.samples + 128).astype(np.uint8).tobytes() == p
        assert [a for a, _ in d.blocks] == list(range(0, len(p), options.get("block", flac.BLOCK)))


def test_predictors_are_used_and_shrink():
    kinds = set()
    for options in ({"max_order": 4}, {"lpc": ([1024, -1024], 10)}, {"linear": 4}):
        for p, s in zip(payloads(), flac.encode(payloads(), **options), strict=True):
            h = flac.header(s)
            for _, offset, _ in h.points:
                at = h.data + offset
                kinds.add(s[at + 8 if s[at + 4] < 0x80 else at + 9] >> 1)
    assert {0, 1, 8, 9} <= kinds and any(10 <= k <= 12 for k in kinds) and any(k >= 32 for k in kinds)
    text = payloads()[5]
    assert len(flac.encode([text])[0]) < len(text)


def without_points(stream):
    h = flac.header(stream)
    return b"fLaC\x80" + stream[5:42] + stream[h.data :]


def test_frames_are_found_without_a_seek_table():
    streams = [without_points(s) for s in flac.encode(payloads(), block=100)]
    assert [(d.ok, (d.samples + 128).astype(np.uint8).tobytes()) for d in flac.decode(streams)] == [(True, p) for p in payloads()]


def bit_string(*fields):
    return "".join(format(v, f"0{w}b") for v, w in fields)


@pytest.mark.parametrize("method", [0, 1])
def test_partitions_and_escapes(method):
    """A frame written by hand: 16 samples, fixed order 1, four partitions, one of them escaped."""
    residuals = [3, -2, 5] + [0, 0, 0, 0] + [-7, 6, -8, 7] + [100, -90, 40, -41]
    samples = np.cumsum([10, *residuals])
    body = bit_string((0, 1), (9, 6), (0, 1), (10, 8), (method, 2), (2, 4))
    w = 4 + method
    zig = lambda r: 2 * r if r >= 0 else -2 * r - 1
    rice = lambda r, k: "0" * (zig(r) >> k) + "1" + (format(zig(r) & (1 << k) - 1, f"0{k}b") if k else "")
    body += format(1, f"0{w}b") + "".join(rice(r, 1) for r in residuals[:3])
    body += "1" * w + format(0, "05b")
    body += "1" * w + format(4, "05b") + "".join(format(r & 15, "04b") for r in residuals[7:11])
    body += format(0, f"0{w}b") + "".join(rice(r, 0) for r in residuals[11:])
    body += "0" * (-len(body) % 8)
    head = b"\xff\xf8\x64\x02\x00\x0f"
    frame = head + bytes([crc_plain(head, 7, 8)]) + int(body, 2).to_bytes(len(body) // 8, "big")
    frame += crc_plain(frame, 0x8005, 16).to_bytes(2, "big")
    got, _, ends, good = flac.decode_frames(frame, np.array([0]), np.array([8]))
    assert good.all() and ends.tolist() == [len(frame)] and got[0].tolist() == samples.tolist()


def test_damage_is_found():
    stream = flac.encode([payloads()[5]])[0]
    h = flac.header(stream)
    for at in (h.data, h.data + 5, h.data + 40, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 0x10
        assert not flac.decode([bytes(bad)])[0].ok
    assert [d.ok for d in flac.decode([b"", b"RIFFxxxx", stream[:50], stream])] == [False, False, False, True]


def test_columns(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "hello " * 3000, "hello " * 3000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "null id", 0)], "doc_id long, text string, media int")
    stored = media.store_texts(df)
    got = {r.doc_id: r for r in media.digest(stored).collect()}
    assert len(got) == len(texts) + 1 and got[6][1:] == got[7][1:]
    for i, t in enumerate(texts):
        p, r = media.padded(t), got[i]
        assert len(p) % 64 == 0 and len(p) >= 64 and r.n_bytes == len((t or "").encode()) and r.payload_bytes == len(p)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-64:])
    blocks = media.decode_blocks(stored).where("doc_id = 6").orderBy("sample_offset").collect()
    assert bytes(np.frombuffer(b"".join(bytes(b.pcm) for b in blocks), np.uint8) ^ 128) == media.padded(texts[6])
    assert [b.sample_offset for b in blocks] == [i * 1024 for i in range(len(blocks))]
    assert media.digest(media.store_texts(df.limit(0))).count() == 0
    assert all(r.feature == plain_feature(media.padded(texts[i])) for i, r in got.items() if i is not None)
    streams = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert all(r.media_bytes == len(streams[i]) and r.media_sha256 == hashlib.sha256(streams[i]).hexdigest() for i, r in got.items())


def plain_feature(payload):
    x = [b - 128 for b in payload]
    bounds = [0]
    for q in range(4):
        bounds.append(bounds[-1] + len(x) // 4 + (q < len(x) % 4))
    quarters = [sum(map(abs, x[a:b])) // max(b - a, 1) for a, b in zip(bounds, bounds[1:])]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
    return f"{len(x)}|{max(map(abs, x))}|{sum(v * v for v in x)}|{crossings}|{','.join(map(str, quarters))}"


@pytest.mark.parametrize("n", [1, 5, 63, 64, 4999, 70_001])
def test_feature(n, monkeypatch):
    monkeypatch.setattr(media, "PART", 1000)
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert media.feature((np.frombuffer(payload, np.uint8) ^ 128).view(np.int8)) == plain_feature(payload)


def test_ids_beside_a_null_one(spark):
    ids = [2**53 + 1, None, 2**53 + 3, 2**63 - 1]
    df = spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string").coalesce(1)
    stored = media.store_texts(df)
    assert {r.doc_id for r in media.digest(stored).collect()} == set(ids) == {r.doc_id for r in media.decode_blocks(stored).collect()}


def test_long_payloads_in_slices(monkeypatch):
    draw = np.random.default_rng(4)
    long = np.cumsum(draw.integers(-3, 4, 70_000)).astype(np.uint8).tobytes()
    whole = flac.encode([*payloads(), long], linear=4)
    monkeypatch.setattr(flac, "SLICE", 4096)
    assert flac.encode([*payloads(), long], linear=4) == whole
    for p, d in zip([*payloads(), long], flac.decode(whole), strict=True):
        assert d.ok and (d.samples + 128).astype(np.uint8).tobytes() == p


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc

    text = ("The river runs under the stone bridge. " * 400_000)[:12_000_000].encode()
    tracemalloc.start()
    stream = flac.encode([text], linear=4)[0]
    d = flac.decode([stream])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert d.ok and (d.samples + 128).astype(np.uint8).tobytes() == text and peak < 30 * len(text)


def test_blocks_are_written_and_sought(spark, tmp_path):
    df = spark.createDataFrame([(1, "a river " * 2000), (2, "short"), (3, None)], "doc_id long, text string")
    media.write_blocks(media.store_texts(df), str(tmp_path / "pcm"))
    blocks = spark.read.parquet(str(tmp_path / "pcm"))
    flip = lambda raw: bytes(b ^ 128 for b in raw)
    for first, count in ((0, 5), (1000, 100), (1024, 1024), (3000, 5000), (15_990, 500), (60, 10)):
        got = {r.doc_id: flip(r.pcm) for r in media.read_samples(blocks, first, count).collect()}
        want = {i: media.padded(t)[first : first + count] for i, t in ((1, "a river " * 2000), (2, "short"), (3, None))}
        assert got == {i: p for i, p in want.items() if p}


def test_null_and_damaged_streams(spark):
    good = flac.encode([b"x" * 3000])[0]
    bad = bytearray(good)
    bad[-1] ^= 1
    rows = spark.createDataFrame([(1, good), (2, None), (3, bytes(bad)), (4, b"no stream")], "doc_id long, media binary")
    lists = {r.doc_id: r for r in media.block_lists(rows).collect()}
    assert [lists[i].ok for i in (1, 2, 3, 4)] == [True, None, False, False] and lists[2].blocks is None
    assert [len(lists[i].blocks) for i in (1, 3, 4)] == [3, 2, 0]
