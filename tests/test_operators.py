"""Relational operators, contents, packages and pages on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import nav, package, pages, progress, relational


def test_ordinals_match_a_window(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", (i * 37) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = sorted([tuple(r) for r in relational.ordinals(df, ["k"], ["v"]).collect()], key=str)
    want, seen = [], {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, seen[k]))
    assert got == sorted(want, key=str)
    assert relational.ordinals(df.limit(0), ["k"], ["v"]).count() == 0


def test_missing_and_appended(spark):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (None,)], "k long")
    assert sorted(str(r.k) for r in relational.missing_from(left, right, ["k"]).collect()) == ["1", "None"]
    tracked = spark.createDataFrame([("a",), ("a",)], "f string")
    got = relational.append_missing(tracked, spark.createDataFrame([("a",), ("b",), ("b",)], "f string"), ["f"])
    assert sorted(map(tuple, got.collect())) == [("a", True), ("b", False)]


def test_picks(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 7, "y"), ("a", 3, 7, "z"), ("b", 1, 0, "w")], "k string, i int, area int, n string")
    assert sorted(map(tuple, relational.largest(df, ["k"], F.col("area"), "i", ["i", "n"]).collect())) == [("a", 2, "y")]
    assert sorted(map(tuple, relational.first_by(df, ["k"], ["i"], ["n"]).collect())) == [("a", "x"), ("b", "w")]
    assert sorted(map(tuple, relational.last_by(df, ["k"], ["i"], ["n"]).collect())) == [("a", "z"), ("b", "w")]


def test_zip_by_position(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x"]), (["a"], ["x", "y"]), ([], ["x"]), (["a"], [])], "l array<string>, r array<string>")
    assert [r[0] for r in df.select(relational.zipped(F.col("l"), F.col("r"))).collect()] == [["x", "b", "c"], ["x"], [], ["a"]]


def test_page_windows(spark):
    pages_ = spark.createDataFrame([("b", i) for i in range(1, 21)], "book string, page_no long")
    chapters = spark.createDataFrame([("b", 1, 1, 4), ("b", 2, 10, 10), ("b", 3, 19, 20), ("b", 4, 9, 5), ("c", 1, 1, 2), ("b", 5, None, 3)], "book string, chapter int, start_page int, end_page int")
    got = {}
    for r in relational.page_windows(chapters, pages_).collect():
        got.setdefault((r.book, r.chapter), []).append(r.page_no)
    assert {k: sorted(v) for k, v in got.items()} == {("b", 1): list(range(1, 8)), ("b", 2): list(range(7, 14)), ("b", 3): [16, 17, 18, 19, 20]}


def test_context_and_ladder(spark):
    df = spark.createDataFrame([("c", 1, "hello"), ("c", 2, "world"), ("d", 1, "x")], "k string, t int, text string")
    for limit, want in ((3, {("c", 1): "", ("c", 2): "hel", ("d", 1): ""}), (0, {("c", 1): "", ("c", 2): "", ("d", 1): ""})):
        got = relational.with_previous(df, ["k"], ["t"], "text", limit, "x").collect()
        assert {(r.k, r.t): r.x for r in got} == want
    sizes = spark.createDataFrame([(10,), (100,), (1000,)], "s long")
    assert [r[0] for r in sizes.select(relational.first_fit(F.col("s"), [1.0, 0.5, 0.1], 60)).collect()] == [0, 1, -1]
    stats = spark.createDataFrame([(2097152, 1048576), (5, 0)], "i long, o long").select(relational.size_stats(F.col("i"), F.col("o")).alias("s")).collect()
    assert tuple(stats[0].s) == (2.0, 1.0, 2.0, 50.0) and stats[1].s.compression_ratio is None and stats[1].s.saved_percentage == 100.0


NCX = '<?xml version="1.0"?><!DOCTYPE ncx PUBLIC "-//X//Y" "http://nowhere.invalid/x.dtd">{0}'
NESTED = """<ncx{0}><navMap><navPoint><navLabel><text>One &amp; é</text></navLabel><content src="a.html"/>
<navPoint><content src="a.html#s"/></navPoint></navPoint><navPoint><navLabel><text/></navLabel><navPoint><navLabel><text>Deep&nbsp;x</text></navLabel><content src="d.html"/></navPoint></navPoint>
<navPoint><navLabel><text>No content</text></navLabel></navPoint></navMap></ncx>"""


@pytest.mark.parametrize("space", ["", ' xmlns="http://www.daisy.org/z3986/2005/ncx/"'])
@pytest.mark.parametrize("wrap", [False, True])
def test_read_points(space, wrap):
    raw = NESTED.format(space)
    got = nav.read_points(NCX.format(raw) if wrap else raw)
    assert got == [("One & é", "a.html"), ("Unknown Title", "a.html#s"), (None, "d.html"), ("Deep\u00a0x", "d.html")]


def test_parse_reports_errors(spark):
    df = spark.createDataFrame([("x", "<ncx>"), ("y", None), ("z", NESTED.format(""))], "book string, content string")
    got = nav.parse(df).collect()
    assert sorted((r.book, r.nav_ord) for r in got if r.error is None) == [("z", 1), ("z", 2), ("z", 3), ("z", 4)]
    assert {r.book for r in got if r.error is not None} == {"x", "y"}


def test_retitle_takes_the_first_match(spark):
    entries = spark.createDataFrame([("b", 1, "A", "t/a.html"), ("b", 2, "B", "t/b.html"), ("b", 3, "A2", "a.html#x")], "book string, nav_ord long, title string, src string")
    new = spark.createDataFrame([("b", 2, "late", "a.html"), ("b", 1, "first", "q/a.html#y"), ("c", 1, "other", "b.html")], "book string, ordinal long, title string, src string")
    got = {r.nav_ord: r.title for r in nav.retitle(entries, new).collect()}
    assert got == {1: "late", 2: "B", 3: "first"}  # names with fragments come before names without
    inside = spark.createDataFrame([("b", 1, "P1", "1.html"), ("b", 2, "P1.1", "1.html#s")], "book string, nav_ord long, title string, src string")
    own = inside.select("book", F.col("nav_ord").alias("ordinal"), F.lower("title").alias("title"), "src")
    assert [r.title for r in nav.retitle(inside, own).orderBy("nav_ord").collect()] == ["p1", "p1.1"]


def test_unused_images(spark):
    rows = [("b", f"images/{n}", "") for n in ("a.jpg", "b.png", "c.jpg", "cover.jpg", "t.jpg")] + [
        ("b", "text/1.html", '<img src="../images/a.jpg"/>'), ("b", "text/2.xhtml", '<img alt="q" src="../images/b.png"/>'), ("b", "content.opf", '<item href="images/cover.jpg" id="cover"/>'),
        ("b", "titlepage.xhtml", '<image xlink:href="images/t.jpg"/>'), ("other", "text/1.html", '<img src="../images/c.jpg"/>'),
    ]
    df = spark.createDataFrame(rows, "book string, member string, content string")
    assert [r.name for r in package.unused_images(df).collect()] == ["c.jpg"]
    assert sorted(r.name for r in package.unused_images(df, strict=True).collect()) == ["b.png", "c.jpg"]
    assert package.pruned(df).count() == len(rows) - 1


def test_manifest_and_opf(spark):
    images = spark.createDataFrame([("b", n) for n in ("z.png", "b.JPG", "a.jpeg", "a.jpg", "x.gif")], "book string, name string")
    assert [(r.name, r.item_id) for r in package.manifest_images(images).orderBy("item_id").collect()] == [("a.jpg", 1), ("b.JPG", 2), ("a.jpeg", 3), ("z.png", 4)]
    books = spark.createDataFrame([("b", "T & <x>", "A", "id", "images/c.jpg"), ("e", None, None, "id2", None)], "book string, title string, author string, identifier string, cover string")
    chapters = spark.createDataFrame([("b", 2), ("b", 1)], "book string, ordinal long")
    got = {r.book: r.opf for r in package.build_opf(books, chapters, images, "2020-01-01T00:00:00").collect()}
    assert got["b"].index("chapter_1.html") < got["b"].index("chapter_2.html") < got["b"].index("images/a.jpg") and "T &amp; &lt;x&gt;" in got["b"]
    assert 'id="cover"' not in got["e"]
    import xml.etree.ElementTree as ET

    assert all(ET.fromstring(x.encode()) is not None for x in got.values())
    new = spark.createDataFrame([(got["b"],)], "o string").select(package.retitled_opf(F.col("o"), F.lit("$1 \\ & new")).alias("o")).first().o
    assert "<dc:title>$1 \\ &amp; new</dc:title>" in new


def test_images_and_placeholders(spark):
    page_rows = spark.createDataFrame([("b", i, 800.0, 1200.0) for i in range(1, 8)], "book string, page_no int, page_width double, page_height double")
    images = spark.createDataFrame([("b", 1, 1, 99, 500), ("b", 1, 2, 300, 300), ("b", 1, 3, 100, 900), ("b", 2, 1, 790, 1190), ("b", 2, 2, 790, 600), ("b", 7, 1, 200, 200)], "book string, page_no int, image_no int, width int, height int")
    kept = pages.kept_images(images, page_rows)
    assert sorted((r.page_no, r.image_no) for r in kept.collect()) == [(1, 2), (1, 3), (2, 2), (7, 1)]
    assert [(r.image_no, r.width) for r in pages.covers(kept).collect()] == [(2, 300)]
    mark = lambda i, p: f'<div class="image-placeholder" id="{i}" data-page="{p}" data-description="d $1"></div>'
    html = f"{mark('a', 0)}|{mark('b', 1)}|{mark('c', 99)}|{mark('d', 3)}"
    chapters = spark.createDataFrame([("b", 1, 2, html), ("b", 2, 5, "plain")], "book string, chapter long, start_page int, html string")
    named = kept.withColumn("name", F.format_string("p%d_%d.jpg", "page_no", "image_no"))
    counts = spark.createDataFrame([("b", 7)], "book string, n_pages int")
    got = {r.chapter: r.html for r in pages.fill_placeholders(chapters, named, counts).collect()}
    parts = got[1].split("|")
    assert "p2_2.jpg" in parts[0] and "d $1" in parts[0] and parts[1] == mark("b", 1) and "p7_1.jpg" in parts[2] and parts[3] == mark("d", 3) and got[2] == "plain"
    legacy = {r.chapter: r.html for r in pages.fill_placeholders(chapters, named, counts, legacy=True).collect()}
    assert "p1_2.jpg" in legacy[1].split("|")[0]


def test_progress(spark):
    log = spark.createDataFrame(
        [("b", "chapter", "1", 1, False, "", 1), ("b", "chapter", "1", 1, True, "x", 2), ("b", "chapter", "2", 2, True, "y", 1), ("b", "chapter", "2", 2, False, "", 3), ("b", "chapter", "5", 5, True, "z", 1)],
        "book string, kind string, item string, ordinal long, done boolean, content string, s int",
    ).withColumn("at", F.timestamp_seconds("s")).drop("s")
    items = spark.createDataFrame([("b", "chapter", str(i)) for i in range(1, 6)], "book string, kind string, item string")
    assert sorted(r.item for r in progress.pending(items, log).collect()) == ["2", "3", "4"]
    assert [r.frontier for r in progress.frontier(log).collect()] == [5]
