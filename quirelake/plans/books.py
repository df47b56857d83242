"""Registered queries of the operators on books: archives, contents, packages, pages, images, requests and checkpoints.

Each supplier stands for a book, of 3 to 9 pages of 800 by 1200, with two or three chapters. Its pages, contents and
structure are made from its key, so each query has the same in SQL over ``supplier`` alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import generate as G
from quirelake.operators import nav, package, pages, progress
from quirelake.plans import flows
from quirelake.plans.registry import query
from quirelake.session import cut, scratch_root
from quirelake.sources import archive, codecs, structure
from quirelake.sources.structure import Config
from quirelake.streaming import sync

_NOW = G.Policy(3, 0.0)


def _books(t):
    """book (text), key, title with markup characters, n_pages."""
    key = F.col("s_suppkey")
    return t("supplier").select(
        key.cast("string").alias("book"), key.alias("key"), F.concat("s_name", F.lit(" & <"), F.col("s_nationkey").cast("string"), F.lit(">")).alias("title"), (key % 7 + 3).alias("n_pages"),
    )


_BOOKS = "(SELECT CAST(s_suppkey AS VARCHAR) AS book, s_suppkey AS key, s_name || ' & <' || s_nationkey || '>' AS title, s_suppkey % 7 + 3 AS n FROM supplier)"
_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _documents(t):
    """book, content: a document of pages. Page 1 has a large image where the key is even and a small one where it is divisible by 3; every
    other page with an even number has one of 300 by 100 + key."""
    line = lambda n: F.concat(
        F.lit('{"width": 800, "height": 1200, "images": ['),
        F.array_join(F.filter(F.array(
            F.when((n == 1) & (F.col("key") % 2 == 0), F.concat(F.lit("[790, "), (F.col("key") % 100 + 1100).cast("string"), F.lit("]"))),
            F.when((n == 1) & (F.col("key") % 3 == 0), F.lit("[50, 60]")),
            F.when((n > 1) & (n % 2 == 0), F.concat(F.lit("[300, "), (F.col("key") % 500 + 50).cast("string"), F.lit("]"))),
        ), lambda x: x.isNotNull()), ", "), F.lit("]}"),
    )
    lines = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n_pages")), line)
    return _books(t).select("book", F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content"))


_IMAGES = f"""(SELECT book, key, 1 AS page_no, 1 AS image_no, 790 AS width, key % 100 + 1100 AS height FROM {_BOOKS} WHERE key % 2 = 0
  UNION ALL SELECT book, key, 1, CASE WHEN key % 2 = 0 THEN 2 ELSE 1 END, 50, 60 FROM {_BOOKS} WHERE key % 3 = 0
  UNION ALL SELECT book, key, p, 1, 300, key % 500 + 50 FROM (SELECT *, unnest(range(2, n + 1)) AS p FROM {_BOOKS}) WHERE p % 2 = 0)"""


@query(f"SELECT book, CAST(n AS BIGINT) AS n_pages FROM {_BOOKS}")
def page_count(t):
    found = codecs.decode_pages(_documents(t), codecs.JsonPages())
    return found.where(F.col("error").isNull()).groupBy("book").agg(F.count(F.lit(1)).alias("n_pages"))


@query(f"SELECT book, CAST(page_no AS INT) AS page_no, CAST(image_no AS INT) AS image_no, CAST(width AS INT) AS width, CAST(height AS INT) AS height FROM {_IMAGES}")
def page_images(t):
    return codecs.decode_images(_documents(t), codecs.JsonPages()).drop("content")


@query(f"SELECT book, CAST(page_no AS INT) AS page_no, hex('\\xff\\xd8\\xff'::BLOB) || hex(width || 'x' || height) AS data FROM {_IMAGES} WHERE width >= 100 AND height >= 100 AND NOT (width > 720 AND height > 1080) AND key % 5 > 0")
def image_convert(t):
    """Images worth keeping as JPEG; the data of every fifth book is lost, so its conversions fail."""
    documents = cut(_documents(t), "documents")
    found = pages.kept_images(codecs.decode_images(documents, codecs.JsonPages()), codecs.decode_pages(documents, codecs.JsonPages()))
    lost = found.withColumn("content", F.when(F.col("book").cast("long") % 5 > 0, F.col("content")))
    done = codecs.as_jpeg(lost, codecs.Marked())
    return done.where(F.col("error").isNull()).select("book", "page_no", F.hex("content").alias("data"))


@query(f"""SELECT book, CAST(CASE WHEN key % 2 = 0 THEN 790 WHEN key % 3 = 0 THEN 50 ELSE 1600 END AS INT) AS width,
  CAST(CASE WHEN key % 2 = 0 THEN key % 100 + 1100 WHEN key % 3 = 0 THEN 60 ELSE 2400 END AS INT) AS height FROM {_BOOKS}""")
def cover_choice(t):
    """The largest image of page 1, of any size; the page itself, drawn, where it has none."""
    documents = cut(_documents(t), "documents")
    plain = codecs.JsonPages()
    drawn = codecs.rendered(documents, plain)
    return flows.cover_images(cut(codecs.decode_images(documents, plain), "images"), codecs.decode_pages(documents, plain), drawn, codecs.Marked()).select("book", "width", "height")


def _chapter_rows(t):
    """Chapters of three pages each, the last one shorter."""
    rows = _books(t).select("book", "title", "n_pages", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("n_pages") / 3))).alias("chapter"))
    first = (F.col("chapter") - 1) * 3 + 1
    return rows.select("book", "chapter", F.concat("title", F.lit(" #"), F.col("chapter").cast("string")).alias("title"), first.alias("start_page"), F.least(first + 2, F.col("n_pages")).alias("end_page"))


_ROWS = f"(SELECT book, key, n, c, title || ' #' || c AS title, 3 * c - 2 AS a, least(3 * c, n) AS b FROM (SELECT *, unnest(range(1, (n + 2) // 3 + 1)) AS c FROM {_BOOKS}))"


@query(f"""SELECT book, c AS chapter, 'Write chapter ' || c || ' as one HTML page. The document holds pages ' || greatest(a - 2, 1) || ' to ' || least(b + 2, n) || ' of the book, the chapter is on pages '
  || a || ' to ' || b || '.' || chr(10) || chr(10) || title AS prompt, CAST(least(b + 2, n) - greatest(a - 2, 1) + 1 AS BIGINT) AS n_sent FROM {_ROWS}""")
def chapter_requests(t):
    """What each chapter is written from: its pages and two more on either side, sent along as a document of their own."""
    documents = cut(_documents(t), "documents")
    asked = cut(flows.chapter_requests(_chapter_rows(t), codecs.decode_pages(documents, codecs.JsonPages()), 2), "requests")
    files = codecs.parts_of(documents, asked, codecs.JsonPages())
    answers = G.generate(asked.join(files, ["book", "chapter"]).select("book", "chapter", "prompt", "attachment"), "prompt", G.ReadBack(), _NOW, "attachment", flows.CHAPTER_ANSWER)
    return answers.select("book", "chapter", "prompt", F.size(F.split("response", "\n")).cast("long").alias("n_sent"))


def _structures(t):
    """book, content: the structure of each book in JSON, with page numbers as text."""
    one = F.struct("title", F.col("start_page").cast("string").alias("start_page"), F.col("end_page").cast("string").alias("end_page"), F.lit("1").alias("level"))
    nested = _chapter_rows(t).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", one.alias("c")))).alias("l"))
    return nested.select("book", F.to_json(F.struct(F.transform("l", lambda x: x["c"]).alias("chapters"))).alias("text"))


_FLAT = f"SELECT book, CAST(c AS INT) AS chapter_index, title, CAST(a AS INT) AS start_page, CAST(b AS INT) AS end_page, 1 AS level FROM {_ROWS}"


@query(_FLAT)
def structure_parse(t):
    """Structures are written as JSON and read by a schema; numbers in quotes are numbers."""
    flat = nav.flatten(structure.parse_structure(_structures(t)).select("book", F.col("structure.chapters").alias("chapters")))
    return flat.select("book", "chapter_index", "title", "start_page", "end_page", "level")


@query(_FLAT)
def structure_extract(t):
    """The structure is asked of a generator that is given the book itself."""
    books = _structures(t).select("book", F.lit("").alias("title"), F.encode("text", "UTF-8").alias("content"))
    found = flows.structures(books, G.ReadBack(), _NOW).where(F.col("error").isNull())
    return nav.flatten(found.select("book", F.col("structure.chapters").alias("chapters"))).select("book", "chapter_index", "title", "start_page", "end_page", "level")


@query(f"""SELECT book, md5('{{"chapters":[' || string_agg('{{"title":"' || title || '","start_page":"' || a || '","end_page":"' || b || '","level":"1"}}', ',' ORDER BY c) || ']}}') AS md5 FROM {_ROWS} GROUP BY book""")
def structure_encode(t):
    return _structures(t).select("book", F.md5("text").alias("md5"))


def _entries(t):
    """Entries of nested contents: each chapter, and below every second one a part of the same file, with a fragment."""
    rows = _chapter_rows(t)
    return rows.withColumn("src", F.concat(F.lit("text/"), F.col("chapter").cast("string"), F.lit(".html")))


def _ncx(t):
    point = F.concat(
        F.lit('<navPoint id="p'), F.col("chapter").cast("string"), F.lit('"><navLabel><text>'), T.escape_xml(F.col("title")), F.lit('</text></navLabel><content src="'), F.col("src"), F.lit('"/>'),
        F.when(F.col("chapter") % 2 == 0, F.concat(F.lit("<navPoint><navLabel><text>Part</text></navLabel><content src=\""), F.col("src"), F.lit('#s"/></navPoint>'))).otherwise(F.lit("")),
        F.lit("</navPoint>"),
    )
    body = _entries(t).groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", point.alias("p")))), lambda x: x["p"]), "").alias("body"))
    head = '<?xml version="1.0"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><head><meta name="dtb:uid" content="keep"/></head><docTitle><text>Old</text></docTitle><navMap>'
    return body.select("book", F.lit("toc.ncx").alias("member"), F.concat(F.lit(head), "body", F.lit("</navMap></ncx>")).alias("content"))


@query(f"""WITH e AS (SELECT book, 2 * c AS o, 'New ' || title AS title, 'text/' || c || '.html' AS src FROM {_ROWS} UNION ALL SELECT book, 2 * c + 1, CASE WHEN key % 2 = 0 THEN 'New part' ELSE 'Part' END, 'text/' || c || '.html#s' FROM {_ROWS} WHERE c % 2 = 0)
  SELECT book, row_number() OVER (PARTITION BY book ORDER BY o) AS nav_ord, title, src, true AS head_kept FROM e""")
def ncx_update(t):
    """Labels of nested contents are changed in place: a chapter's by its file, a part's by its fragment; every second book has none for its parts."""
    entries = _entries(t)
    new = entries.select("book", F.col("chapter").alias("ordinal"), F.concat(F.lit("OEBPS/"), "src").alias("src"), F.concat(F.lit("New "), "title").alias("title"))
    part = entries.where((F.col("chapter") % 2 == 0) & (F.col("book").cast("long") % 2 == 0))
    new = new.unionByName(part.select("book", F.col("chapter").alias("ordinal"), F.concat("src", F.lit("#s")).alias("src"), F.lit("New part").alias("title")))
    done = cut(nav.retitled(_ncx(t), new), "contents")
    kept = done.select("book", (F.col("ncx").contains('content="keep"') & F.col("ncx").contains("<text>Old</text>")).alias("head_kept"))
    return nav.parse(done, text_col="ncx").drop("error").join(kept, "book")


def _members(t):
    """A book's files: its chapters but the last, two pages that no entry names, and files that are no pages."""
    chapters = _entries(t).join(_books(t).select("book", F.ceil(F.col("n_pages") / 3).alias("last")), "book").where(F.col("chapter") < F.col("last"))
    named = chapters.select("book", F.concat(F.lit("OEBPS/"), "src").alias("member"))
    fixed = F.explode(F.array(*map(F.lit, ("OEBPS/extra.htm", "a/extra.html", "OEBPS/notes.xhtml", "OEBPS/style.css", "OEBPS/toc.ncx", "a/toc.ncx", "OEBPS/content.opf"))))
    return named.unionByName(_books(t).select("book", fixed.alias("member"))).withColumn("content", F.lit(""))


_MEMBERS = f"""(SELECT book, 'OEBPS/text/' || c || '.html' AS member FROM {_ROWS} WHERE 3 * c < n
  UNION ALL SELECT book, unnest(['OEBPS/extra.htm', 'a/extra.html', 'OEBPS/notes.xhtml', 'OEBPS/style.css', 'OEBPS/toc.ncx', 'a/toc.ncx', 'OEBPS/content.opf']) FROM {_BOOKS})"""


@query(f"SELECT book, member FROM {_MEMBERS} WHERE member LIKE '%.htm%'")
def html_members(t):
    return archive.html_members(_members(t)).select("book", "member")


@query(f"SELECT book, min(member) FILTER (WHERE member LIKE '%/toc.ncx') AS contents, min(member) FILTER (WHERE member LIKE '%/content.opf') AS package FROM {_MEMBERS} GROUP BY book")
def first_members(t):
    """The contents and the package document: of several, the one with the smallest path."""
    members = cut(_members(t), "members")
    found = lambda name, column: archive.first_member(members, name).select("book", F.col("member").alias(column))
    return found("toc.ncx", "contents").join(found("content.opf", "package"), "book")


@query(f"""WITH w AS (SELECT book, 0 AS r, c AS o, 'OEBPS/text/' || c || '.html' AS member, title, 'ok' AS status FROM {_ROWS} WHERE 3 * c < n
  UNION ALL SELECT book, 0, c, 'text/' || c || '.html', title, 'missing_source' FROM {_ROWS} WHERE 3 * c >= n
  UNION ALL SELECT book, 0, c + 0.5, 'text/' || c || '.html#s', 'Part', 'missing_source' FROM {_ROWS} WHERE 3 * c >= n AND c % 2 = 0
  UNION ALL SELECT book, 1, 0, member, NULL, 'ok' FROM {_MEMBERS} WHERE member LIKE '%extra.htm%')
  SELECT book, row_number() OVER (PARTITION BY book ORDER BY r, o, member) AS ordinal, CASE r WHEN 0 THEN 'chapter' ELSE 'extra' END AS kind, member, title, status FROM w""")
def work_list(t):
    """Files to translate: chapters in order, each file once, missing ones named, then the pages that no entry names."""
    entries = cut(nav.parse(_ncx(t)).drop("error"), "entries")
    return flows.work_list(cut(_members(t), "members"), entries)


@query(f"SELECT book, title, upper(title) AS translated, md5('<package><dc:title>' || {_ESCAPED.format('upper(title)')} || '</dc:title></package>') AS md5 FROM {_BOOKS}")
def title_translate(t):
    """A book's title is read from its package, translated by a generator, and put back."""
    packages = _books(t).select("book", F.concat(F.lit("<package><dc:title>"), T.escape_xml(F.col("title")), F.lit("</dc:title></package>")).alias("content"))
    named = flows.translated_titles(packages, G.Echo(str.upper), Config(), _NOW)
    return packages.join(named, "book").select("book", "title", "translated", F.md5(package.retitled_opf(F.col("content"), F.col("translated"))).alias("md5"))


@query(f"""SELECT book, md5('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>Contents</title></head><body><h1>Contents</h1><ol>' || chr(10)
  || string_agg('<li class="level-1"><a href="chapter_' || c || '.html">' || {_ESCAPED.format('title')} || '</a></li>' || chr(10), '' ORDER BY c) || '</ol></body></html>') AS md5 FROM {_ROWS} GROUP BY book""")
def contents_page(t):
    entries = _chapter_rows(t).select("book", F.col("chapter").alias("ordinal"), F.lit(1).alias("level"), "title", F.concat(F.lit("chapter_"), F.col("chapter").cast("string"), F.lit(".html")).alias("href"))
    return nav.contents_html(entries).select("book", F.md5("html").alias("md5"))


@query(f"""SELECT book, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml">' || chr(10) || '<head><title>Cover</title><style>img {{ '
  || CASE WHEN key % 2 = 0 THEN 'aspect-ratio: 790 / ' || key % 100 + 1100 || '; ' ELSE '' END || 'max-height: 100% }}</style></head>' || chr(10)
  || '<body><p><img alt="Cover" src="images/a&amp;' || key || '.jpg"/></p></body>' || chr(10) || '</html>' || chr(10)) AS md5 FROM {_BOOKS}""")
def title_page(t):
    name = F.concat(F.lit("images/a&"), F.col("book"), F.lit(".jpg"))
    even = F.col("key") % 2 == 0
    page = package.title_page(name, F.when(even, F.lit(790)), F.when(even, F.col("key") % 100 + 1100))
    return _books(t).select("book", F.md5(page).alias("md5"))


@query(f"""SELECT book, m.member, md5(m.content) AS md5 FROM {_BOOKS}, (VALUES ('mimetype', 'application/epub+zip'),
  ('META-INF/container.xml', '<?xml version="1.0"?>' || chr(10) || '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
  ('stylesheet.css', 'body {{ margin: 5%; line-height: 1.6 }}' || chr(10) || 'img {{ max-width: 100%; height: auto }}' || chr(10) || 'h1, h2 {{ text-align: center }}' || chr(10))) AS m(member, content)""")
def fixed_members(t):
    return package.fixed_members(_books(t)).select("book", "member", F.md5("content").alias("md5"))


@query(f"""SELECT book, c AS chapter, md5('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || {_ESCAPED.format('title')} || '</title><link rel="stylesheet" href="../stylesheet.css"/></head><body><p>' || c || '</p></body></html>') AS md5 FROM {_ROWS}""")
def chapter_page(t):
    page = pages.chapter_page(F.col("title"), F.concat(F.lit("<p>"), F.col("chapter").cast("string"), F.lit("</p>")))
    return _chapter_rows(t).select("book", "chapter", F.md5(page).alias("md5"))


@query(f"""SELECT doc_id, md5(replace({_ESCAPED.format("coalesce(text, '')")}, '"', '&quot;')) AS md5, md5(coalesce(text, '')) AS back FROM documents""")
def xml_escape(t):
    """Texts escaped for XML, and back."""
    text = F.coalesce("text", F.lit(""))
    escaped = T.escape_xml(text)
    return t("documents").select("doc_id", F.md5(escaped).alias("md5"), F.md5(T.unescape_xml(escaped)).alias("back"))


@query("SELECT doc_id, md5(left(text, 200)) AS prefix, md5(left(text, 500) || chr(10) || ' ... ' || chr(10) || right(text, 500)) AS preview FROM documents")
def text_preview(t):
    return t("documents").select("doc_id", F.md5(T.prefix(F.col("text"), 200)).alias("prefix"), F.md5(T.preview(F.col("text"))).alias("preview"))


@query("SELECT doc_id, round(strlen(text) / 1048576.0::DOUBLE, 9) AS mb, 'urn:sha256:' || sha256(text) AS identifier FROM documents")
def size_and_identifier(t):
    return t("documents").select("doc_id", F.round(T.megabytes(F.octet_length("text")), 9).alias("mb"), F.concat(F.lit("urn:sha256:"), F.sha2("text", 256)).alias("identifier"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events")
def iso_stamp(t):
    return t("events").select("event_id", T.utc_stamp(F.col("ts")).alias("stamp"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Title ' || page_id WHEN page_id % 3 = 1 THEN 'p.' || page_id ELSE 'p' || page_id END AS title FROM pages")
def title_or_stem(t):
    """A given title, else the file name without its last extension."""
    number = F.col("page_id").cast("string")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Title "), number)).when(F.col("page_id") % 3 == 1, F.lit(""))
    path = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("a.b/p."), number, F.lit(".pdf"))).otherwise(F.concat(F.lit("dir/p"), number, F.lit(".html")))
    return t("pages").select("page_id", T.title_or_stem(given, path).alias("title"))


@query("""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents), r AS (SELECT doc_id, n, [n, CAST(floor(n * 0.6) AS BIGINT), CAST(floor(n * 0.25600000000000006) AS BIGINT), CAST(floor(n * 0.06666666666666667) AS BIGINT)] AS s FROM d)
  SELECT doc_id, CAST(CASE WHEN s[1] <= 900 THEN 0 WHEN s[2] <= 900 THEN 1 WHEN s[3] <= 900 THEN 2 WHEN s[4] <= 900 THEN 3 ELSE -1 END AS INT) AS rung,
    CAST(CASE WHEN s[1] <= 900 THEN s[1] WHEN s[2] <= 900 THEN s[2] WHEN s[3] <= 900 THEN s[3] ELSE s[4] END AS BIGINT) AS output_size FROM r""")
def compress_ladder(t):
    """Each file is compressed a rung at a time until it is small enough, with a compressor that keeps a known share."""
    books = t("documents").select(F.col("doc_id").cast("string").alias("book"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    done = codecs.bounded(books, codecs.Sampling(), 900)
    return done.select(F.col("book").cast("long").alias("doc_id"), "rung", "output_size")


@query("SELECT n_nationkey, 'ok ' || n_name AS response, CAST(3 AS INT) AS attempts, CAST(NULL AS VARCHAR) AS error FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, NULL, 2, 'ConnectionError: attempt 2' FROM nation WHERE n_nationkey % 2 = 1")
def retry_calls(t):
    """A service that fails twice: three attempts are enough, two are not."""
    asked = t("nation").withColumn("prompt", F.concat(F.lit("go\n\nok "), "n_name")).select("n_nationkey", "prompt")
    some = lambda rest, attempts: G.generate(asked.where(F.col("n_nationkey") % 2 == rest), "prompt", G.Flaky(G.Echo(), 2), G.Policy(attempts, 0.0))
    return some(0, 3).unionByName(some(1, 2)).drop("prompt")


@query(f"SELECT book, c AS chapter FROM {_ROWS} WHERE NOT (c = 1 OR (c = 2 AND key % 2 = 0))")
def checkpoint_cycle(t):
    """A first run notes chapter 1 as done and chapter 2 as failed; a second one does chapter 2 of every second book. The rest is pending."""
    path = f"{scratch_root(t('supplier').sparkSession)}/quirelake/log-{uuid.uuid4().hex}"
    items = _chapter_rows(t).select("book", F.lit("chapter").alias("kind"), F.col("chapter").cast("string").alias("item"), F.col("chapter").alias("ordinal"))
    note = lambda rows, done, at: progress.append(rows.select("*", F.lit(done).alias("done"), F.lit("").alias("content"), F.lit(at).cast("timestamp").alias("at")), path)
    note(items.where("item = '1'"), True, "2020-01-01 00:00:00")
    note(items.where("item = '2'"), False, "2020-01-01 00:00:00")
    note(items.where("item = '2' AND CAST(book AS BIGINT) % 2 = 0"), True, "2020-01-02 00:00:00")
    log = items.sparkSession.read.schema(progress.SCHEMA).parquet(path)
    return progress.pending(items, log).select("book", F.col("ordinal").alias("chapter"))


class _Carried:
    """Answers with the first part of the prompt, where the text before is shown."""

    def generate(self, request, attempt):
        return "<html>" + request.prompt.partition("\n\n")[0].replace("<html>", "") + "</html>"


@query("""WITH RECURSIVE n AS (SELECT n_regionkey AS r, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
  a(r, i, response) AS (SELECT r, i, '<html>go</html>' FROM n WHERE i = 1
    UNION ALL SELECT n.r, n.i, '<html>' || replace('go' || chr(10) || 'Before: ' || left(a.response, 12), '<html>', '') || '</html>' FROM a JOIN n ON n.r = a.r AND n.i = a.i + 1)
  SELECT n.k AS n_nationkey, a.response FROM a JOIN n ON n.r = a.r AND n.i = a.i""")
def context_carry(t):
    """Each answer is given the start of the one before it, book by book in order."""
    items = t("nation").select(F.col("n_regionkey").cast("string").alias("book"), F.col("n_nationkey").cast("long").alias("ordinal"), F.lit("").alias("member"), F.lit("x").alias("html"))
    done = G.translate_items(items, _Carried(), "go", _NOW, context_limit=12)
    return done.select(F.col("ordinal").cast("int").alias("n_nationkey"), "response")


_FILES = "(SELECT 'r' || n_regionkey || '/' || n_name || '.txt' AS relative, n_name || chr(10) || n_nationkey AS content, n_nationkey FROM nation)"


@query(f"SELECT relative, md5(CASE WHEN n_nationkey % 4 = 0 THEN content || '!' ELSE content END) AS md5, CAST(strlen(content) + CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM {_FILES}")
def folder_sync(t):
    """Files are put into a folder and copied; some change under their name and are copied again; the copy is listed and read."""
    nations = t("nation")
    spark, base = nations.sparkSession, f"{scratch_root(nations.sparkSession)}/quirelake/sync-{uuid.uuid4().hex}"
    source, target = f"{base}/in", f"{base}/out"
    files = nations.select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.lit(".txt")).alias("relative"), F.concat("n_name", F.lit("\n"), F.col("n_nationkey").cast("string")).alias("text"))
    sync.write_files(files.select("relative", F.encode("text", "UTF-8").alias("content")), source)
    sync.sync_changed(spark, source, target, f"{base}/state")
    some = files.where(F.col("n_nationkey") % 4 == 0).select("relative", F.encode(F.concat("text", F.lit("!")), "UTF-8").alias("content"))
    sync.write_files(some, source)
    sync.sync_changed(spark, source, target, f"{base}/state")
    listed = structure.listing(spark, target) if structure.folder_exists(spark, target) else structure.listing(spark, source).limit(0)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    read = read.select(F.concat(F.element_at(F.split("path", "/"), -2), F.lit("/"), F.element_at(F.split("path", "/"), -1)).alias("relative"), F.md5("content").alias("md5"))
    return listed.join(read, "relative").select("relative", "md5", "size")


@query("""SELECT * FROM (VALUES ('title', 'A: title', 'Given'), ('author', 'None', ''), ('num_retries', '7', '7'), ('target_language', '', 'German'), ('max_backoff_seconds', '', '30.0')) AS c(key, in_file, merged)""")
def config_file(t):
    """Settings of a file as text, and with those given on top over the defaults."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:  # read by the driver alone
        path = Path(folder) / "config.yaml"
        path.write_text("title: 'A: title '\nauthor: null\nnum_retries: 7\nunknown: 1\n", encoding="utf-8")
        merged = structure.load_config(str(path), title="Given", target_language="German")
        rows = [(k, structure.config_value(str(path), k), str(v) if (v := getattr(merged, k)) is not None else "") for k in ("title", "author", "num_retries", "target_language", "max_backoff_seconds")]
    return t("region").sparkSession.createDataFrame(rows, "key string, in_file string, merged string")
