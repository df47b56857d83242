"""PDF files made by hand: plain, compressed, revised and damaged."""

import struct
import zlib

import pytest

from quirelake.sources import codecs, pdf
from quirelake.sources.pdf import Name, Ref, Stream

JPEG = b"\xff\xd8\xff\xe0 some data endobj \xff\xd9"


def named(**items):
    return {Name(k.encode()): v for k, v in items.items()}


def objects(n=3):
    gray = bytes(range(6))
    out = {
        1: named(Type=Name(b"Catalog"), Pages=Ref(2)),
        2: named(Type=Name(b"Pages"), Kids=[Ref(3), Ref(10)], Count=n, MediaBox=[0, 0, 400.5, Ref(9)]),
        3: named(Type=Name(b"Pages"), Parent=Ref(2), Kids=[Ref(4), Ref(5)], Count=2, Resources=named(XObject=named(I1=Ref(6), F=Ref(8)))),
        4: named(Type=Name(b"Page"), Parent=Ref(3), Contents=Ref(7)),
        5: named(Type=Name(b"Page"), Parent=Ref(3), Rotate=90, Resources=named(XObject=named(A=Ref(6), B=Ref(11)))),
        6: Stream(named(Subtype=Name(b"Image"), Width=300, Height=200, Filter=Name(b"DCTDecode")), JPEG),
        7: Stream(named(Filter=[Name(b"FlateDecode")]), zlib.compress(b"BT (page one) Tj ET 4 0 obj")),
        8: Stream(named(Subtype=Name(b"Form")), b"q Q"),
        9: 600,
        10: named(Type=Name(b"Page"), Parent=Ref(2), MediaBox=[10, 20, 110, 220], Title=b"(\\)\xff", Odd=Name(b"a b#/")),
        11: Stream(named(Subtype=Name(b"Image"), Width=3, Height=2, BitsPerComponent=8, ColorSpace=Name(b"DeviceGray"), Filter=Name(b"FlateDecode")), zlib.compress(gray)),
    }
    return out


def test_pages_and_images():
    got = pdf.PdfPages().pages(pdf.write(objects(), 1))
    assert [(p.width, p.height) for p in got] == [(400.5, 600.0), (600.0, 400.5), (100.0, 200.0)]
    assert got[0].images == ((300, 200, JPEG),) and got[2].images == ()
    png = got[1].images[1][2]
    assert got[1].images[0][2] == JPEG and png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (3, 2)
    size = struct.unpack(">I", png[33:37])[0]
    assert zlib.decompress(png[41 : 41 + size]) == b"\0\0\1\2\0\3\4\5"


def test_parts_are_files_of_their_own():
    raw = pdf.write(objects(), 1)
    plain = pdf.PdfPages()
    whole = plain.pages(raw)
    for first, last in ((1, 1), (2, 3), (1, 3), (3, 9)):
        part = plain.part(raw, first, last)
        assert plain.pages(part) == whole[first - 1 : last]
    one = pdf.Document(plain.part(raw, 1, 1))
    assert b"page one" in one.data(one.get(one.pages()[0][b"Contents"])) and len(plain.part(raw, 3, 3)) < len(raw) / 2
    third = pdf.Document(plain.part(raw, 3, 3)).pages()[0]
    assert third[b"Title"] == b"(\\)\xff" and third[b"Odd"] == b"a b#/"


def test_object_streams_and_revisions():
    every = objects()
    inner = [1, 2, 3, 4, 5, 9, 10]
    bodies = [pdf._write(every[n]) for n in inner]
    offsets = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
    head = b" ".join(b"%d %d" % pair for pair in zip(inner, offsets, strict=True)) + b" "
    packed = Stream(named(Type=Name(b"ObjStm"), N=len(inner), First=len(head), Filter=Name(b"FlateDecode")), zlib.compress(head + b" ".join(bodies)))
    rest = {n: v for n, v in every.items() if n not in inner} | {20: packed, 21: Stream(named(Type=Name(b"XRef"), Root=Ref(1)), b"")}
    raw = pdf.write(rest, 1).partition(b"xref\n")[0] + b"startxref\n0\n%%EOF"
    assert pdf.PdfPages().pages(raw) == pdf.PdfPages().pages(pdf.write(every, 1))
    revised = raw + b"\n9 0 obj\n% a comment\n  700 \nendobj\n5 0 obj\n<</Type/Page/Parent 3 0 R/MediaBox[0 0 1 2]>>\nendobj\n"
    assert [(p.width, p.height) for p in pdf.PdfPages().pages(revised)] == [(400.5, 700.0), (1.0, 2.0), (100.0, 200.0)]


@pytest.mark.parametrize("raw", [b"", b"no file", b"%PDF-1.4 nothing", pdf.write({1: named(Type=Name(b"Catalog"), Pages=Ref(2))}, 1).replace(b"/Root", b"/Encrypt 5 0 R /Root")])
def test_what_cannot_be_read(raw):
    with pytest.raises(ValueError):
        pdf.PdfPages().pages(raw)


def test_strings_and_circles():
    parse = lambda raw: pdf._Parser(raw).value()
    assert parse(rb"(a\(b\) (nested) \101\n\\ x\7)") == b"a(b) (nested) A\n\\ x\x07" and parse(b"<4 1 4>") == b"A@" and parse(b"[1 -2.5 .5 true null /N#20x 3 0 R]") == [1, -2.5, 0.5, True, None, b"N x", Ref(3)]
    circle = pdf.write({1: named(Type=Name(b"Catalog"), Pages=Ref(2)), 2: named(Kids=[Ref(2), Ref(3)]), 3: Ref(3)}, 1)
    with pytest.raises(ValueError):
        pdf.PdfPages().pages(circle)


def test_as_a_source(spark):
    raw = pdf.write(objects(), 1)
    df = spark.createDataFrame([("a", bytearray(raw)), ("bad", bytearray(b"x"))], "book string, content binary")
    got = codecs.decode_pages(df, pdf.PdfPages()).collect()
    assert sorted((r.book, r.page_no, r.n_images) for r in got if r.error is None) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 0)] and {r.book for r in got if r.error} == {"bad"}
    images = codecs.decode_images(df, pdf.PdfPages())
    assert images.count() == 3 and codecs.as_jpeg(images, codecs.Marked()).where("error IS NULL").count() == 3
    parts = codecs.parts_of(df, spark.createDataFrame([("a", 1, 2, 3)], "book string, chapter int, first int, last int"), pdf.PdfPages()).first()
    assert [p.width for p in pdf.PdfPages().pages(bytes(parts.attachment))] == [600.0, 100.0]
    assert codecs.rendered(df, pdf.PdfPages()).select("width", "height").collect() == [(300, 200)]


def test_repacking():
    every = objects() | {30: Stream(named(), b"unused " * 900)}
    every[8] = Stream(named(Subtype=Name(b"Form")), b"q Q " * 900)
    raw = pdf.write(every, 1)
    small = pdf.Repack().compress(raw, 150, 60, False)
    assert len(small) < len(raw) / 3 and pdf.PdfPages().pages(small) == pdf.PdfPages().pages(raw)
    assert len(pdf.Repack().compress(small, 1, 1, True)) <= len(small)
