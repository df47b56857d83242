"""Generators, archives, sync and whole flows with the offline parts."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.operators import generate as G
from quirelake.plans import cli, flows
from quirelake.sources import archive, codecs, structure
from quirelake.streaming import sync

NOW = G.Policy(attempts=3, sleep=lambda s: None)
PAGE = "<html><head><title>{0}</title></head><body><div>{0}</div></body></html>"


def test_retry_and_waits():
    waits = []
    policy = G.Policy(attempts=3, cap_seconds=3.0, sleep=waits.append)
    assert policy.call(G.Flaky(G.Echo(), 2), "p\n\nx") == ("x", 3, None) and waits == [2.1, 3.0]
    text, used, error = policy.call(G.Flaky(G.Echo(), 9), "p\n\nx")
    assert text is None and used == 3 and "attempt 3" in error
    assert policy.call(G.Scripted({"q": ["", "late"]}), "q") == ("late", 2, None)
    assert NOW.call(G.Echo(), "no body")[2] == "empty answer"


def test_continuation():
    whole = PAGE.format("x" * 50)
    assert G.continued(G.Truncating(G.Echo(), 30), NOW, "p\n\n" + whole, 20)[:2] == (whole, -(-len(whole) // 30))
    text, calls, error = G.continued(G.Truncating(G.Echo(), 10), NOW, "p\n\n" + whole, 2)
    assert text == whole[:30] and calls == 3 and error == "incomplete"
    assert G.continued(G.Truncating(G.Echo(), 10), NOW, "p\n\n" + whole, None)[:2] == (whole, -(-len(whole) // 10))
    assert G.continued(G.Truncating(G.Echo(), 10), NOW, "p\n\n<html>open", None) == ("<html>open", 4, "empty answer")  # ends with a call that adds nothing
    restart = G.Scripted({"p\n\n1": "<html><body>ha", "p\n\n1" + G.CONTINUE + "<html><body>ha": PAGE.format("again")})
    assert G.continued(restart, NOW, "p\n\n1", 3)[0] == PAGE.format("again")


def test_context_is_carried_within_a_book(spark):
    rows = [(b, i, f"{i}.html", PAGE.format(f"{b}{i}")) for b in "ab" for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "book string, ordinal long, member string, html string").repartition(3)

    class Seen:
        def generate(self, request, attempt):
            return "<html>" + request.prompt.partition("\n\n")[0].replace("<html>", "") + "</html>"

    got = {(r.book, r.ordinal): r.response for r in G.translate_items(df, Seen(), "go", NOW, context_limit=12).collect()}
    assert got["a", 1] == "<html>go</html>" and got["a", 2] == "<html>go\nBefore: go</ht</html>" and got["b", 3] == "<html>go\nBefore: go\nBef</html>"


def test_titles_by_number_and_position(spark):
    df = spark.createDataFrame([("b", i, f"t{i}") for i in range(1, 13)], "book string, ordinal long, title string")
    asked = lambda a, b: "go\n\n" + "\n".join(f"{j}. t{i}" for j, i in enumerate(range(a, b), 1))
    answers = G.Scripted({asked(1, 11): "\n2. two\n\n１. one\n4. \n99. none", asked(11, 13): "1. eleven\n\n2. twelve"})
    got = {r.ordinal: r.translated for r in G.translate_titles(df, answers, "go", NOW).collect()}
    assert got[1] == "one" and got[2] == "two" and got[3] == "t3" and got[4] == "" and got[11] == "eleven" and got[12] == "twelve"
    placed = {r.ordinal: r.translated for r in G.translate_titles(df, answers, "go", NOW, by_position=True).collect()}
    assert placed[1] == "two" and placed[2] == "" and placed[3] == "one" and placed[6] == "t6" and placed[12] == ""


def test_archives(spark):
    members = [("mimetype", b"application/epub+zip"), ("text/1.html", b"<p>1"), ("images/a.jpg", bytes(range(256)))]
    raw = archive.pack(members[::-1])
    assert raw == archive.pack(members)
    with zipfile.ZipFile(__import__("io").BytesIO(raw)) as z:
        assert z.infolist()[0].filename == "mimetype" and [i.compress_type for i in z.infolist()] == [0, 8, 8]
    df = spark.createDataFrame([("a", bytearray(raw)), ("bad", bytearray(b"PK nothing")), ("none", None)], "book string, content binary")
    got = archive.members_of(df).collect()
    assert {(r.member, bytes(r.content)) for r in got if r.error is None} == set(members) and {r.book for r in got if r.error} == {"bad", "none"}
    assert [archive.safe_name(n) for n in ("a/b", "../x", "/etc/x", "a\\..\\b", "C:/x", "./a//b", "")] == ["a/b", None, None, None, None, "a/b", None]


NCX = """<?xml version="1.0"?>
<!DOCTYPE ncx PUBLIC "-//NISO//DTD ncx 2005-1//EN" "http://nowhere.invalid/ncx.dtd">
<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="id-7"/></head><docTitle><text>Real Title</text></docTitle><navMap>
<navPoint id="a" playOrder="1"><navLabel><text>c1</text></navLabel><content src="text/1.html"/><navPoint id="b"><navLabel><text>c1 part</text></navLabel><content src="text/1.html#s"/></navPoint></navPoint>
<navPoint id="c"><navLabel><text>c2 &amp; more</text></navLabel><content src="text/2.html#x"/></navPoint><navPoint id="d"><navLabel><text>c9</text></navLabel><content src="text/9.html"/></navPoint>
</navMap><pageList><pageTarget id="p1"><navLabel><text>1</text></navLabel></pageTarget></pageList></ncx>"""


def books(n=2, ncx=NCX):
    out = []
    for b in range(n):
        parts = [("mimetype", "application/epub+zip"), ("content.opf", f"<dc:title>old &amp; {b}</dc:title>"), ("toc.ncx", ncx), ("text/1.html", PAGE.format("one")), ("text/2.html", PAGE.format("two")), ("extra.htm", PAGE.format("extra")), ("x.xhtml", "keep")]
        out.append((f"book{b}", bytearray(archive.pack([(m, c.encode()) for m, c in parts if c]))))
    return out


def test_work_list(spark):
    members = archive.members_of(spark.createDataFrame(books(1), "book string, content binary"))
    from quirelake.operators import nav

    entries = nav.parse(archive.first_member(members, "toc.ncx")).drop("error")
    got = [(r.ordinal, r.kind, r.member, r.title, r.status) for r in flows.work_list(members, entries).orderBy("ordinal").collect()]
    assert got == [(1, "chapter", "text/1.html", "c1", "ok"), (2, "chapter", "text/2.html", "c2 & more", "ok"), (3, "chapter", "text/9.html", "c9", "missing_source"), (4, "extra", "extra.htm", None, "ok")]


@pytest.mark.parametrize("limit", [0, 20])
def test_translate_books(spark, limit, tmp_path):
    from quirelake.operators import nav, progress

    df = spark.createDataFrame([*books(), ("broken", bytearray(b"PK")), ("bare", bytearray(archive.pack([("text/1.html", b"<p>")]))), ("torn", books(1, "<ncx>")[0][1])], "book string, content binary")
    done = [("book0", "page", "text/2.html", 2, True, "<html>kept</html>")]
    log = spark.createDataFrame(done, "book string, kind string, item string, ordinal long, done boolean, content string").withColumn("at", F.lit("2020-01-01").cast("timestamp"))
    path = str(tmp_path / "log")
    progress.append(log, path)
    change = lambda s: s.replace("one", "eins").replace("c1", "K1 $").replace("old", "neu")
    out = flows.translate_books(df, G.Echo(change), structure.Config(previous_content_limit=limit), NOW, path).cache()
    errors = {r.book: r.error for r in out.where("error IS NOT NULL").collect()}
    assert set(errors) == {"broken", "bare", "torn"} and errors["bare"] == "no toc.ncx"
    got = {(r.book, r.member): bytes(r.content).decode() for r in archive.members_of(out.where("error IS NULL")).collect()}
    assert got["book0", "text/1.html"] == PAGE.format("eins") and got["book0", "text/2.html"] == "<html>kept</html>" and got["book1", "text/2.html"] == PAGE.format("two")
    assert got["book1", "content.opf"] == "<dc:title>neu &amp; 1</dc:title>" and got["book1", "x.xhtml"] == "keep"
    ncx = got["book1", "toc.ncx"]
    assert nav.read_points(ncx) == [("K1 $", "text/1.html"), ("K1 $ part", "text/1.html#s"), ("c2 & more", "text/2.html#x"), ("c9", "text/9.html")]
    assert 'content="id-7"' in ncx and "Real Title" in ncx and "<!DOCTYPE ncx" in ncx and "pageTarget" in ncx and ncx.index('id="b"') < ncx.index('id="c"') and "ns0:" not in ncx
    # what was answered is in the log now, so nothing is asked again
    again = flows.translate_books(df, G.Scripted({}), structure.Config(target_title="Neu & $1", num_retries=1), G.Policy(1, sleep=lambda s: None), path)
    again = {(r.book, r.member): bytes(r.content).decode() for r in archive.members_of(again.where("error IS NULL")).collect()}
    assert again["book1", "text/1.html"] == PAGE.format("eins") and again["book1", "content.opf"] == "<dc:title>Neu &amp; $1</dc:title>"


STRUCTURE = json.dumps({"chapters": [{"title": "A & B", "start_page": "1", "end_page": 3}, {"title": "C", "start_page": 4, "end_page": 6, "level": "1", "subchapters": [{"title": "s", "start_page": 5, "end_page": 5, "level": 2}]}]})


def writer():
    class Writer:  # in a function, so that it travels to the workers by value
        """Reads what comes with a request: the structure from a whole book, a chapter from its pages."""

        def generate(self, request, attempt):
            pages = len(codecs.JsonPages().pages(request.attachment))
            if request.answer_type == "application/json":
                return STRUCTURE if pages == 6 and request.temperature == 0.0 else "no"
            return f'```html\n<html><body><div class="image-placeholder" id="i" data-page="2" data-description="pic"></div>{pages} pages. ' + request.prompt.partition("\n\n")[2].replace("&", "&amp;") + "</body></html>\n```"

    return Writer()


def test_generate_books(spark, tmp_path):
    sizes = {0: [[900, 1400], [300, 400]], 2: [[300, 400]]}
    raw = "\n".join(json.dumps({"width": 800, "height": 1200, "images": sizes.get(i, [])}) for i in range(6))
    bare = "\n".join(json.dumps({"width": 800, "height": 1200, "images": []}) for i in range(6))
    rows = [("dir/b.pdf", bytearray(raw.encode()), "", "An Author"), ("dir/c.pdf", bytearray(bare.encode()), "", "N")]
    books_ = spark.createDataFrame(rows, "book string, content binary, title string, author string")
    structured = flows.structures(books_, writer(), NOW).cache()
    row = structured.where("book LIKE '%b.pdf'").first()
    assert row.title == "b" and row.error is None and [c.start_page for c in row.structure.chapters] == [1, 4] and row.structure.chapters[1].subchapters[0].level == 2
    log = str(tmp_path / "log")
    members = flows.generate_books(books_, structured, codecs.JsonPages(), writer(), "2020-01-01T00:00:00", NOW, 1, log)
    got = {(r.book[4], r.member): bytes(r.content).decode("utf-8", "replace") for r in members.collect()}
    assert '<img src="../images/page_3_1.jpg" alt="pic"' in got["b", "text/chapter_1.html"] and "image-placeholder" in got["b", "text/chapter_2.html"] and "4 pages. A &amp; B" in got["b", "text/chapter_1.html"]
    assert {"mimetype", "META-INF/container.xml", "content.opf", "toc.ncx", "titlepage.xhtml", "text/toc.html", "images/page_1_2.jpg", "images/page_3_1.jpg", "images/cover.jpg"} <= {m for b, m in got if b == "b"} | {"images/page_1_2.jpg"}
    assert got["b", "images/cover.jpg"].endswith("900x1400") and got["c", "images/cover.jpg"].endswith("page 1") and 'aspect-ratio: 900 / 1400; ' in got["b", "titlepage.xhtml"]
    assert "page_3_1.jpg" in got["b", "content.opf"] and got["b", "content.opf"].count("cover.jpg") == 1 and archive.archives_of(members).count() == 2
    again = flows.generate_books(books_, structured, codecs.JsonPages(), G.Scripted({}), "2020-01-01T00:00:00", G.Policy(1, sleep=lambda s: None), 1, log)
    assert {r.member: bytes(r.content) for r in again.where("member LIKE 'text/chapter%'").collect()}.keys() == {"text/chapter_1.html", "text/chapter_2.html"}
    bad = flows.structures(books_.withColumn("title", F.lit("T")), G.Echo(lambda s: "x"), NOW).first()
    assert bad.error == "no structure" and bad.title == "T"


def test_images_that_fail_to_convert_are_left_out(spark):
    rows = [("b", 1, 1, 10, 10, bytearray(b"raw")), ("b", 1, 2, 20, 20, bytearray(codecs.JPEG + b"x")), ("b", 1, 3, 30, 30, bytearray(b"")), ("b", 1, 4, 30, 30, None)]
    df = spark.createDataFrame(rows, "book string, page_no int, image_no int, width int, height int, content binary")
    got = {r.image_no: (bytes(r.content) if r.content is not None else None, r.error) for r in codecs.as_jpeg(df, codecs.Marked()).collect()}
    assert got == {1: (codecs.JPEG + b"raw", None), 2: (codecs.JPEG + b"x", None), 3: (None, "no image data"), 4: (None, "no image data")}


def test_ladder_over_a_codec(spark):
    df = spark.createDataFrame([("s", bytearray(40)), ("m", bytearray(100)), ("l", bytearray(2000))], "book string, content binary")
    got = {r.book: (r.rung, r.output_size) for r in codecs.bounded(df, codecs.Sampling(), 50).collect()}
    assert got == {"s": (0, 40), "m": (2, 25), "l": (-1, 133)}
    with pytest.raises(ValueError):
        codecs.checked_quality(101)


def test_config_and_listing(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("title: ' T '\nauthor: null\nnum_retries: 7\nunknown: 1\n", encoding="utf-8")
    assert structure.load_config(str(path), num_retries=None, target_language="German") == structure.Config(title=" T ", num_retries=7, target_language="German")
    assert [structure.config_value(str(path), k) for k in ("title", "author", "none")] == ["T", "None", ""] and structure.config_value("/nowhere", "x") is None
    for name in ("book/a.txt", "book/sub/b.txt", "book2/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted(r.relative for r in structure.listing(spark, str(tmp_path), "book").collect()) == ["a.txt", "sub/b.txt"]
    assert structure.folder_exists(spark, str(tmp_path)) and not structure.folder_exists(spark, str(tmp_path / "no"))


def test_sync(spark, tmp_path):
    source, target, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    os.makedirs(f"{source}/sub")
    open(f"{source}/a.bin", "wb").write(b"\0a")
    open(f"{source}/sub/b.txt", "w").write("b")
    before = spark.createDataFrame(structure.listing(spark, source).collect(), "relative string, modified timestamp, size long")
    sync.sync_once(spark, source, target, mark)
    open(f"{source}/c.txt", "w").write("c")
    sync.sync_once(spark, source, target, mark)
    assert sorted(os.path.relpath(os.path.join(d, f), target) for d, _, fs in os.walk(target) for f in fs if not f.endswith(".crc")) == ["a.bin", "c.txt", "sub/b.txt"]
    open(f"{source}/a.bin", "wb").write(b"longer")
    assert sorted(r.relative for r in sync.changed(structure.listing(spark, source), before).collect()) == ["a.bin", "c.txt"]


def test_sync_of_changed_files(spark, tmp_path):
    source, target, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    os.makedirs(f"{source}/sub")
    open(f"{source}/a.bin", "wb").write(b"a")
    open(f"{source}/sub/b.txt", "w").write("b")
    assert sync.sync_changed(spark, source, target, state) == 2 and sync.sync_changed(spark, source, target, state) == 0
    open(f"{source}/a.bin", "wb").write(b"changed")
    waits = []
    sync.poll(spark, source, f"file://{target}", state, 5.0, 2, sleep=waits.append)
    assert waits == [5.0] and open(f"{target}/a.bin", "rb").read() == b"changed" and open(f"{target}/sub/b.txt").read() == "b"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    conf = tmp_path / "c.yaml"
    conf.write_text("title: T\n", encoding="utf-8")
    assert cli.main(["config", str(conf), "title"]) == 0 and capsys.readouterr().out.strip() == "T"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.epub").write_bytes(bytes(books(1)[0][1]))
    command = ["translate", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", str(conf), "-t", "German", "--log", str(tmp_path / "log")]
    assert cli.main(command, spark) == 2  # no service, no run
    assert cli.main([*command, "--generator", "quirelake.operators.generate:Echo"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and spark.read.parquet(str(tmp_path / "log")).where("done").count() == 3
    assert cli.main(["shrink", str(tmp_path / "in"), str(tmp_path / "small"), "--quality", "30"], spark) == 2
    assert cli.main(["shrink", str(tmp_path / "in"), str(tmp_path / "small"), "--quality", "30"], spark, compressor=codecs.Sampling()) == 0
    row = spark.read.parquet(str(tmp_path / "small")).first()
    assert row.output_size == int(row.input_size * 0.3) and row.stats.compression_ratio > 3
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"width": 8, "height": 9}) for _ in range(6)))
    files = ["-i", str(tmp_path / "b.jsonl"), "-o"]
    assert cli.main(["generate", *files, str(tmp_path / "made"), "--title", "T"], spark, writer(), codecs.JsonPages()) == 0
    made = archive.members_of(spark.read.parquet(str(tmp_path / "made")).select("book", "content"))
    assert "1970" not in bytes(made.where("member = 'content.opf'").first().content).decode()
    assert cli.main(["structure", *files, str(tmp_path / "structure")], spark, writer()) == 0
    assert cli.main(["sync", str(tmp_path / "down"), str(tmp_path / "in"), "--checkpoint", str(tmp_path / "mark"), "--download"], spark) == 0
    assert (tmp_path / "down/b.epub").read_bytes() == (tmp_path / "in/b.epub").read_bytes()
