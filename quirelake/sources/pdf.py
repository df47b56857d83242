"""Pages of PDF files without a PDF library: objects, the page tree, embedded images, and files made of some of the pages.

What is read: plain and compressed objects (object streams), later revisions over earlier ones, attributes that pages inherit,
Flate and JPEG data, sampled images of 8 bits in grey or RGB. Objects are found by their headers, so a damaged cross-reference
table does no harm. Encrypted files raise ``ValueError``. Nothing is drawn: ``render`` gives a page's image only where one
JPEG covers all of it, as on scanned pages.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass
from typing import Any

from quirelake.sources.codecs import Page

_SPACE = b"\0\t\n\f\r "
_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")
_REFERENCE = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_WORD = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MOST_INFLATED = 1 << 30


class Name(bytes):
    """A name, without its slash."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes


class _Parser:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def skip(self) -> None:
        raw, at = self.raw, self.at
        while at < len(raw):
            if raw[at] in _SPACE:
                at += 1
            elif raw[at : at + 1] == b"%":
                ends = [i for i in (raw.find(b"\n", at), raw.find(b"\r", at)) if i >= 0]
                at = min(ends) if ends else len(raw)
            else:
                break
        self.at = at

    def value(self) -> Any:
        self.skip()
        raw, at = self.raw, self.at
        if raw.startswith(b"<<", at):
            self.at += 2
            items = self._until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        head = raw[at : at + 1]
        if head == b"[":
            self.at += 1
            return self._until(b"]")
        if head == b"(":
            return self._string()
        if head == b"<":
            end = raw.index(b">", at)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if head == b"/":
            word = _WORD.match(raw, at + 1)
            self.at = word.end() if word else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word[0] if word else b""))
        if found := _REFERENCE.match(raw, at):
            self.at = found.end()
            return Ref(int(found[1]))
        if found := _NUMBER.match(raw, at):
            self.at = found.end()
            return float(found[0]) if b"." in found[0] else int(found[0])
        if found := _WORD.match(raw, at):
            self.at = found.end()
            return {b"true": True, b"false": False}.get(found[0])
        raise ValueError(f"no value at byte {at}")

    def _until(self, end: bytes) -> list:
        out = []
        while True:
            self.skip()
            if self.at >= len(self.raw):
                raise ValueError("an object is cut off")
            if self.raw.startswith(end, self.at):
                self.at += len(end)
                return out
            out.append(self.value())

    def _string(self) -> bytes:
        raw, at, depth, out = self.raw, self.at + 1, 1, []
        while at < len(raw):
            c = raw[at : at + 1]
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(raw, at + 1)
                if octal:
                    out.append(bytes([int(octal[0], 8) & 255]))
                    at = octal.end()
                else:
                    following = raw[at + 1 : at + 2]
                    out.append(b"" if following in (b"\n", b"\r") else _ESCAPES.get(following, following))
                    at += 2
                continue
            depth += (c == b"(") - (c == b")")
            at += 1
            if not depth:
                self.at = at
                return b"".join(out)
            out.append(c)
        raise ValueError("a string is cut off")


def _inflate(raw: bytes) -> bytes:
    worker = zlib.decompressobj()
    out = worker.decompress(raw, MOST_INFLATED)
    if worker.unconsumed_tail:
        raise ValueError("too large")
    return out


class Document:
    """The objects of a file by number; the last definition of each counts."""

    def __init__(self, raw: bytes):
        if not raw.lstrip()[:1024].startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        self.raw, self.places, self.made = raw, {}, {}
        end = 0
        roots: list[dict] = []
        for found in _OBJECT.finditer(raw):
            if found.start() < end:  # inside a stream
                continue
            number = int(found[1])
            self.places[number] = found.end()
            self.made.pop(number, None)
            try:
                value, end = self._read(found.end())
            except ValueError:
                continue
            if isinstance(value, Stream):
                kind = value.info.get(b"Type")
                if kind == b"ObjStm":
                    self._unpack(value)
                elif kind == b"XRef":
                    roots.append(value.info)
        for found in re.finditer(rb"trailer", raw):
            try:
                roots.append(_Parser(raw, found.end()).value())
            except ValueError:
                continue
        roots = [r for r in roots if isinstance(r, dict)]
        if any(b"Encrypt" in r for r in roots):
            raise ValueError("the file is encrypted")
        root = next((r[b"Root"] for r in reversed(roots) if b"Root" in r), None)
        self.catalog = self.get(root) if root is not None else next((v for v in map(self.object, self.places) if isinstance(v, dict) and v.get(b"Type") == b"Catalog"), None)
        if not isinstance(self.catalog, dict):
            raise ValueError("no catalog")

    def _read(self, at: int) -> tuple[Any, int]:
        parser = _Parser(self.raw, at)
        value = parser.value()
        parser.skip()
        if not isinstance(value, dict) or not self.raw.startswith(b"stream", parser.at):
            return value, parser.at
        start = parser.at + 6
        start += 2 if self.raw.startswith(b"\r\n", start) else 1
        length = value.get(b"Length")
        length = self.get(length) if isinstance(length, Ref) and length.number in self.places else length
        if not isinstance(length, int) or not self.raw[start + length : start + length + 12].lstrip(_SPACE).startswith(b"endstream"):
            stop = self.raw.find(b"endstream", start)
            length = (stop if stop >= 0 else len(self.raw)) - start
        return Stream(value, self.raw[start : start + length]), start + length

    def _unpack(self, stream: Stream) -> None:
        body = self.data(stream)
        head = _Parser(body)
        pairs = [(head.value(), head.value()) for _ in range(self.get(stream.info[b"N"]))]
        first = self.get(stream.info[b"First"])
        for number, offset in pairs:
            self.places[number] = None
            self.made[number] = _Parser(body, first + offset).value()

    def object(self, number: int) -> Any:
        if number not in self.made:
            place = self.places.get(number)
            self.made[number] = self._read(place)[0] if place is not None else None
        return self.made[number]

    def get(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.object(value.number)
        raise ValueError("references in a circle")

    def filters(self, stream: Stream) -> list[bytes]:
        found = self.get(stream.info.get(b"Filter"))
        return [self.get(f) for f in found] if isinstance(found, list) else [found] if found is not None else []

    def data(self, stream: Stream) -> bytes:
        """The stream behind its Flate filters; other filters stay, and end it."""
        raw = stream.raw
        for kind in self.filters(stream):
            if kind != b"FlateDecode":
                return raw
            raw = _inflate(raw)
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        out, seen = [], set()
        todo: list[tuple[Any, dict]] = [(self.catalog.get(b"Pages"), {})]
        while todo:
            node, given = todo.pop()
            if isinstance(node, Ref):
                if node.number in seen:
                    continue
                seen.add(node.number)
            value = self.get(node)
            if not isinstance(value, dict):
                continue
            given = given | {k: value[k] for k in (b"MediaBox", b"Resources", b"Rotate", b"CropBox") if k in value}
            kids = self.get(value.get(b"Kids"))
            if isinstance(kids, list):
                todo += [(k, given) for k in reversed(kids)]
            else:
                out.append(value | given)
        return out


def _png(width: int, height: int, channels: int, samples: bytes) -> bytes:
    row = width * channels
    if len(samples) < row * height:
        raise ValueError("samples are missing")
    lines = b"".join(b"\0" + samples[i * row : (i + 1) * row] for i in range(height))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def _image(document: Document, stream: Stream) -> tuple[int, int, bytes]:
    """Width, height and data: JPEG (or JPEG 2000) as it is, samples as PNG, nothing where they can't be read."""
    info = stream.info
    width, height = int(document.get(info.get(b"Width")) or 0), int(document.get(info.get(b"Height")) or 0)
    kinds = document.filters(stream)
    if kinds and kinds[-1] in (b"DCTDecode", b"JPXDecode"):
        return width, height, document.data(stream)
    channels = {b"DeviceRGB": 3, b"DeviceGray": 1, b"CalRGB": 3, b"CalGray": 1}.get(document.get(info.get(b"ColorSpace")) if not isinstance(document.get(info.get(b"ColorSpace")), list) else b"")
    plain = all(k == b"FlateDecode" for k in kinds) and b"DecodeParms" not in info and document.get(info.get(b"BitsPerComponent")) == 8
    try:
        return width, height, _png(width, height, channels, document.data(stream)) if plain and channels else b""
    except (ValueError, zlib.error):
        return width, height, b""


def _write(value: Any) -> bytes:
    if isinstance(value, Name):
        return b"/" + re.sub(rb"[^!-~]|[#()<>\[\]{}/%]", lambda m: b"#%02x" % m[0][0], value)
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if value is None:
        return b"null"
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, bytes):
        return b"<" + value.hex().encode() + b">"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, list):
        return b"[" + b" ".join(map(_write, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(_write(Name(k)) + b" " + _write(v) for k, v in value.items()) + b">>"
    return _write(value.info | {Name(b"Length"): len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"


def write(objects: dict[int, Any], root: int) -> bytes:
    """A file of these objects, with its cross-reference table."""
    out, places, size = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], {}, 15
    for number, value in sorted(objects.items()):
        body = b"%d 0 obj\n" % number + _write(value) + b"\nendobj\n"
        places[number] = size
        out.append(body)
        size += len(body)
    most = max(objects) + 1
    lines = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(most))
    out.append(b"xref\n0 %d\n" % most + lines + b"trailer\n" + _write({Name(b"Size"): most, Name(b"Root"): Ref(root)}) + b"\nstartxref\n%d\n%%%%EOF\n" % size)
    return b"".join(out)


@dataclass(frozen=True)
class PdfPages:
    """The decoder of PDF files."""

    def pages(self, raw: bytes) -> list[Page]:
        document = Document(raw)
        out = []
        for page in document.pages():
            box = [float(document.get(x)) for x in document.get(page.get(b"MediaBox")) or (0, 0, 612, 792)]
            width, height = abs(box[2] - box[0]), abs(box[3] - box[1])
            if (document.get(page.get(b"Rotate")) or 0) % 180:
                width, height = height, width
            resources = document.get(page.get(b"Resources")) or {}
            found = [document.get(x) for x in (document.get(resources.get(b"XObject")) or {}).values()]
            images = tuple(_image(document, x) for x in found if isinstance(x, Stream) and x.info.get(b"Subtype") == b"Image")
            out.append(Page(width, height, images))
        return out

    def part(self, raw: bytes, first: int, last: int) -> bytes:
        """A file of the pages first to last and what they refer to."""
        document, objects, numbers = Document(raw), {}, {}

        def taken(value: Any) -> Any:
            """The value with references to objects of the new file; parents and other pages are left out."""
            if isinstance(value, Ref):
                target = document.get(value)
                if isinstance(target, dict) and target.get(b"Type") in (b"Page", b"Pages", b"Catalog"):
                    return None
                if value.number not in numbers:
                    numbers[value.number] = len(numbers) + len(kept) + 3
                    todo.append((numbers[value.number], target))
                return Ref(numbers[value.number])
            if isinstance(value, list):
                return [taken(v) for v in value]
            if isinstance(value, dict):
                return {k: taken(v) for k, v in value.items() if k != b"Parent"}
            return Stream(taken(value.info), value.raw) if isinstance(value, Stream) else value

        kept, todo = document.pages()[max(first, 1) - 1 : last], []
        for i, page in enumerate(kept):
            objects[3 + i] = taken({k: v for k, v in page.items() if k not in (b"Annots", b"B", b"StructParents")}) | {Name(b"Parent"): Ref(2)}
        while todo:
            number, value = todo.pop()
            objects[number] = taken(value)
        objects[1] = {Name(b"Type"): Name(b"Catalog"), Name(b"Pages"): Ref(2)}
        objects[2] = {Name(b"Type"): Name(b"Pages"), Name(b"Kids"): [Ref(3 + i) for i in range(len(kept))], Name(b"Count"): len(kept)}
        return write(objects, 1)

    def render(self, raw: bytes, page_no: int) -> tuple[int, int, bytes]:
        page = self.pages(raw)[page_no - 1]
        scans = [i for i in page.images if i[2].startswith(b"\xff\xd8\xff")]
        if len(page.images) != 1 or not scans:
            raise NotImplementedError("a page can't be drawn here; plug in a decoder that draws")
        return scans[0]


@dataclass(frozen=True)
class Repack:
    """A compressor that loses nothing: objects that no page refers to go, and plain streams are compressed. Images stay as they
    are, so resolution, quality and colour don't matter."""

    def compress(self, raw: bytes, dpi: int, quality: int, grey: bool) -> bytes:
        plain = PdfPages()
        whole = Document(plain.part(raw, 1, len(Document(raw).pages())))
        objects = {}
        for number in whole.places:
            value = whole.object(number)
            if isinstance(value, Stream) and b"Filter" not in value.info:
                small = zlib.compress(value.raw, 9)
                if len(small) < len(value.raw):
                    value = Stream(value.info | {Name(b"Filter"): Name(b"FlateDecode")}, small)
            objects[number] = value
        packed = write(objects, 1)
        return packed if len(packed) < len(raw) else raw
