"""Personal data against a plain reading of the patterns with Python's ``re``."""

import hashlib
import re

import pytest

from quirelake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    text = text or ""
    spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


CASES = [
    None, "", "   ", "mail a.b@c.org, or é😀 x@y-z.co.uk.", "a@b.com_x@y.org a@b.com@c.org a..b@c..d.e",
    "@x.y a@.b.c a@b. a@b.c. \x01a@b.c \x02.@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 0.0.0.0 9999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111  1111 1111 1111 -4111111111111111-", "0000 0000 0000", "+1 (415) 555-0100 x +44 20 7946 0958. ++49 30 901820 +1 2",
    "😀 +33 1 42 68 53 00 😀 4012888888881881 a+b@c.de", "1 " * 3000, "a@" + "b." * 9000 + "c", "1." * 9000 + "1", "9" * 50000, "x@y " * 400, "a" * 50000, "+1 " * 500 + "2345678901",
]


@pytest.mark.parametrize("repeat", [1, 2])
def test_base_spans_match_plain_patterns(spark, repeat):
    rows = [(i, t) for i, t in enumerate(CASES)] * repeat + [(None, "x@y.zz")]
    got = pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]


def test_random_texts(spark):
    import random

    draw = random.Random(5)
    rows = [(i, "".join(draw.choice("01259 -.+@aB(_%é😀\x01") for _ in range(draw.randrange(0, 400)))) for i in range(1500)]
    got = {r.doc_id: r.base_sha256 for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == hashlib.sha256(",".join(brute(t)).encode()).hexdigest() for i, t in rows)


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 here"), (2, "IBAN DE88 3704 0044 0532 0130 00 here"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "GB82WEST12345698765432")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "iban:5:32" in got[1] and "iban" not in got[2]
    assert got[3] == "ssn:4:15" and got[4] == ""
    assert "iban:0:22" in got[5]


def test_redaction_and_empty_table(spark):
    df = spark.createDataFrame([(1, "é a@b.co and +1 415 555 0100!", 9), (2, None, 9), (3, "none", 9)], "doc_id long, text string, pii_x int")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "é [EMAIL] and [PHONE]!", 2: None, 3: "none"}
    assert pii.digest(df.limit(0)).count() == 0


def plain_redaction(text, spans):
    out, at = [], 0
    for s in spans.split(",") if spans else []:
        kind, a, b = s.split(":")
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


@pytest.mark.parametrize("step,block", [(2, 5), (128, 1024)])
def test_redaction_of_many_spans(spark, monkeypatch, step, block):
    import random

    monkeypatch.setattr(pii, "_STEP", step)
    monkeypatch.setattr(pii, "_BLOCK", block)
    draw = random.Random(9)
    parts = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 415 555 0100", "ssn 123-45-6789", "é😀", " ", "x.y", "a@1.2.3.4", "mail "]
    rows = [(i, "".join(draw.choice(parts) for _ in range(draw.randrange(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {i: plain_redaction(t, spans[i]) for i, t in rows}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "write a@b.co", 1, 2, 3, 4)], "doc_id long, text string, pii int, Blocks int, w_email int, s_ip int")
    assert pii.redact(df).collect() == [(1, "write [EMAIL]", 1, 2, 3, 4)] and pii.redact(df).columns == df.columns
    assert [(r.n_email, r.scores) for r in pii.digest(df).collect()] == [(1, "10")]


def test_work_grows_with_the_matches(spark):
    """A log of 100,000 addresses (1.2 MB) in one text; by the square of the matches it took minutes."""
    import time

    text = "10.20.30.40 " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    assert pii.digest(df).first().n_ip == 100_000
    assert pii.redact(df).first().text == "[IP] " * 100_000
    assert time.time() - begun < 60
