"""Registered queries of the book and document operators, each with the same in DuckDB SQL.

The tables stand in for a library: ``pages`` are a book's HTML members or a model's responses, ``documents`` of
one source are the pages of one book in order of id, ``conversations`` are chunks of a response, ``events`` a
progress log, the others keyed relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import html as H
from quirelake.functions import text as T
from quirelake.operators import generate as G
from quirelake.operators import nav, package, pages, relational, progress
from quirelake.plans.registry import QUERIES, SQL
from quirelake.plans.registry import query as _query
from quirelake.session import cut
from quirelake.sources import archive
from quirelake.streaming import sync

_STRIP = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"
_FULL = r"regexp_extract({0}, '(?s)(?:<\?xml.*?\?>)?(?:<!DOCTYPE.*?>)?(?:<html.*?>).*?</html>')"
_DIV = r"regexp_extract({0}, '(?s)<div.*?>.*?</div>')"
_CLEAN = "CASE WHEN contains({0}, '</html>') AND " + _FULL + " <> '' THEN " + _STRIP.format(_FULL) + " ELSE " + _STRIP.format(_DIV) + " END"


def queries() -> dict:
    from quirelake.plans import books  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


@_query(f"""SELECT page_id, 'ok' AS status, CASE WHEN contains(html, '</html>') AND {_FULL.format("html")} <> '' THEN 'full'
  WHEN regexp_matches(html, '(?s)<body.*?>.*?</body>') THEN 'body' ELSE 'div' END AS match_kind FROM pages""")
def html_classify(t):
    """What each response holds."""
    return H.clean(t("pages"), "html").select("page_id", "cleaned.status", "cleaned.match_kind")


@_query(f"SELECT page_id, md5(c) AS md5, CAST(length(c) AS BIGINT) AS len FROM (SELECT page_id, {_CLEAN.format('html')} AS c FROM pages)")
def html_clean_hash(t):
    """What is kept of each response."""
    done = H.clean(t("pages"), "html").withColumn("c", F.col("cleaned.content"))
    return done.select("page_id", F.md5("c").alias("md5"), F.length("c").cast("long").alias("len"))


@_query(f"SELECT page_id, md5({_CLEAN.format('html')}) AS md5 FROM pages")
def fence_strip(t):
    """Responses inside code fences are cleaned to the same."""
    fenced = t("pages").withColumn("html", F.concat(F.lit("```html\n"), "html", F.lit("\n```\n")))
    return H.clean(fenced, "html").select("page_id", F.md5("cleaned.content").alias("md5"))


@_query("SELECT page_id, md5(html) AS md5, md5(html) AS string_md5 FROM pages")
def json_envelope_unwrap(t):
    """JSON objects and JSON strings around a response come off."""
    whole = F.to_json(F.struct("html"))
    string = F.regexp_extract(whole, r'(?s)^\{"html":(.*)\}$', 1)
    return t("pages").select("page_id", F.md5(T.json_text(whole)).alias("md5"), F.md5(T.json_text(string)).alias("string_md5"))


@_query(f"SELECT page_id, 'ok' AS status, CAST(length({_CLEAN.format('html')}) AS BIGINT) AS len FROM pages")
def continuation_merge(t):
    """The second half of a response continues the first."""
    half = F.floor(F.length("html") / 2).cast("int")
    cutted = t("pages").withColumns({"before": F.left("html", half), "after": F.substr("html", half + 1)})
    done = H.clean(cutted, "after", F.col("before"))
    return done.select("page_id", "cleaned.status", F.length("cleaned.content").cast("long").alias("len"))


@_query("SELECT page_id, 'partial' AS status, md5(h) AS md5 FROM (SELECT page_id, left(html, strpos(html, '</div>') - 1) AS h FROM pages WHERE strpos(html, '</div>') > 1)")
def partial_detect(t):
    """Responses cut before the first closing tag are partial."""
    at = F.instr("html", "</div>")
    cutted = t("pages").where(at > 1).withColumn("html", F.left("html", at - 1))
    return H.clean(cutted, "html").select("page_id", "cleaned.status", F.md5("cleaned.content").alias("md5"))


@_query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS md5, CAST(sum(length(text)) AS BIGINT) AS len FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def chunk_accumulate(t):
    """Chunks of a response, in order, as one text."""
    done = relational.joined_text(t("conversations"), ["conv_id"], ["turn"], "text")
    return done.select("conv_id", F.md5("text").alias("md5"), F.length("text").cast("long").alias("len"))


@_query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def title_extract(t):
    return t("pages").select("page_id", H.title(F.col("html")).alias("title"))


@_query("SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS l FROM pages)")
def link_inventory(t):
    found = t("pages").withColumn("l", H.links(F.col("html")))
    return found.select("page_id", F.size("l").cast("long").alias("n_links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"))


@_query(r"SELECT page_id, md5(regexp_replace(html, '<title>[^\n]*?</title>', '<title>Cost $5 \\ ' || page_id || '</title>', 'g')) AS md5 FROM pages")
def title_replace(t):
    """A new title with characters that replacements give a meaning to."""
    title = F.concat(F.lit("Cost $5 \\ "), F.col("page_id").cast("string"))
    return t("pages").select("page_id", F.md5(T.replace_element(F.col("html"), "title", title)).alias("md5"))


@_query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def unreferenced_parts(t):
    """Parts that no large order line has."""
    used = t("lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return relational.missing_from(t("part").select("p_partkey"), used, ["p_partkey"])


@_query("SELECT doc_id, true AS tracked FROM labels UNION SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untracked_append(t):
    return relational.append_missing(t("labels").select("doc_id"), t("documents").select("doc_id"), ["doc_id"])


@_query("""SELECT p_partkey, CAST(o AS BIGINT) AS l_orderkey, l AS l_linenumber FROM part LEFT JOIN (
  SELECT l_partkey, l_orderkey AS o, l_linenumber AS l FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1) ON l_partkey = p_partkey""")
def first_match_join(t):
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber")
    return relational.first_match(t("part").select("p_partkey"), lines, ["p_partkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"])


@_query(r"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CASE WHEN i <= len(l) // 2 THEN upper(l[i]) ELSE l[i] END AS title
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(translate(text, 'ßıŉǰΐΰևẖẗẘẙẚ', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL))""")
def positional_zip(t):
    """Answers for the first half of a document's lines; the other lines stay."""
    rows = t("documents").select("doc_id", T.lines(F.translate("text", "ßıŉǰΐΰևẖẗẘẙẚ", "")).alias("l"))
    answers = F.transform(F.slice("l", F.lit(1), F.floor(F.size("l") / 2).cast("int")), F.upper)
    zipped = rows.select("doc_id", F.posexplode(relational.zipped(F.col("l"), answers)).alias("pos", "title"))
    return zipped.withColumn("pos", F.col("pos").cast("long"))


@_query("""WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, n_chars FROM documents),
  c AS (SELECT source, max(n) AS most, unnest(range(0, (max(n) + 9) // 10)) AS chapter FROM p GROUP BY source)
  SELECT c.source, CAST(chapter AS BIGINT) AS chapter, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS chars
  FROM c JOIN p ON p.source = c.source AND n BETWEEN greatest(10 * chapter + 1 - 3, 1) AND least(10 * chapter + 10, most) + 3 GROUP BY ALL""")
def page_window(t):
    """Chapters of ten pages, with three more on either side."""
    docs = cut(relational.ordinals(t("documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "page_no"), "pages")
    book = docs.withColumnRenamed("source", "book")
    per = book.groupBy("book", F.floor((F.col("page_no") - 1) / 10).cast("long").alias("chapter")).agg(F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"))
    met = relational.page_windows(per, book)
    return met.groupBy(F.col("book").alias("source"), "chapter").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_chars").alias("chars"))


@_query("SELECT source, doc_id FROM documents WHERE n_chars > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def cover_argmax(t):
    return relational.largest(t("documents"), ["source"], F.col("n_chars"), "doc_id", ["doc_id"])


@_query("""SELECT p_partkey FROM (SELECT p_partkey, p_size * 25 AS w, p_retailprice AS h FROM part)
  WHERE NOT (w < 100 OR h < 100) AND NOT (w > 0.9 * 800 AND h > 0.9 * 1200)""")
def image_filter(t):
    sized = t("part").select("p_partkey", (F.col("p_size") * 25).alias("w"), F.col("p_retailprice").alias("h"))
    return sized.where(pages.worth_keeping(F.col("w"), F.col("h"), F.lit(800.0), F.lit(1200.0))).select("p_partkey")


@_query("""SELECT c_nationkey, CAST((rn - 1) // 10 AS BIGINT) AS batch, count(*) AS n, string_agg(((rn - 1) % 10 + 1) || '. ' || c_name, chr(10) ORDER BY rn) AS joined
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) GROUP BY ALL""")
def batch_of_ten(t):
    numbered = relational.batches(t("customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], ["c_custkey"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "c_name"))), lambda x: x["c_name"])
    return numbered.groupBy("c_nationkey", "batch").agg(F.count(F.lit(1)).alias("n"), T.numbered(listed).alias("joined"))


@_query("SELECT conv_id, turn, md5(coalesce(lag(left(text, 100)) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS context_md5 FROM conversations")
def context_lag(t):
    rows = relational.with_previous(t("conversations"), ["conv_id"], ["turn"], "text", 100, "context")
    return rows.select("conv_id", "turn", F.md5("context").alias("context_md5"))


@_query("""SELECT source, doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS class,
  row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS item_id FROM documents""")
def manifest_numbering(t):
    """Items of a book numbered through its classes."""
    extension = F.when(F.col("lang") == "en", ".jpg").when(F.col("lang") == "de", ".jpeg").otherwise(".png")
    images = t("documents").select(F.col("source").alias("book"), "doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), extension).alias("name"))
    return package.manifest_images(images).select(F.col("book").alias("source"), "doc_id", "class", "item_id")


_CHAPTERS = "(SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS o FROM nation)"


def _chapters(t):
    """Nations as chapters of their regions."""
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_regionkey").alias("book"), F.col("r_name").alias("book_title"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"))
    return relational.ordinals(rows, ["book"], ["key"]).withColumn("identifier", F.concat(F.lit("id-"), F.col("book").cast("string")))


@_query(f"""SELECT r_regionkey AS book, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1" xml:lang="en">' || chr(10)
  || '<head><meta name="dtb:uid" content="id-' || r_regionkey || '"/></head>' || chr(10) || '<docTitle><text>' || r_name || '</text></docTitle>' || chr(10) || '<navMap>' || chr(10)
  || '<navPoint id="cover" playOrder="1"><navLabel><text>Cover</text></navLabel><content src="titlepage.xhtml"/></navPoint>' || chr(10)
  || '<navPoint id="toc" playOrder="2"><navLabel><text>Contents</text></navLabel><content src="text/toc.html"/></navPoint>' || chr(10)
  || string_agg('<navPoint id="chapter_' || o || '" playOrder="' || (o + 2) || '"><navLabel><text>' || n_name || '</text></navLabel><content src="text/chapter_' || o || '.html"/></navPoint>' || chr(10), '' ORDER BY o)
  || '</navMap>' || chr(10) || '</ncx>' || chr(10)) AS md5 FROM {_CHAPTERS} JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def nav_assembly(t):
    return nav.build(_chapters(t)).select("book", F.md5("ncx").alias("md5"))


@_query(f"""SELECT r_regionkey AS book, o + 2 AS nav_ord, n_name AS title, 'text/chapter_' || o || '.html' AS src FROM {_CHAPTERS} JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_regionkey, 1, 'Cover', 'titlepage.xhtml' FROM region UNION ALL SELECT r_regionkey, 2, 'Contents', 'text/toc.html' FROM region""")
def nav_parse(t):
    """What was built is read back."""
    return nav.parse(nav.build(_chapters(t)), text_col="ncx").drop("error")


@_query(f"""SELECT r_regionkey AS book, o + 2 AS nav_ord, upper(n_name) || '!' AS title, 'text/chapter_' || o || '.html' AS src FROM {_CHAPTERS} JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_regionkey, 1, 'Cover', 'titlepage.xhtml' FROM region UNION ALL SELECT r_regionkey, 2, 'Contents', 'text/toc.html' FROM region""")
def nav_retitle(t):
    """Entries get the titles of translated chapters by file name."""
    chapters = cut(_chapters(t), "chapters")
    entries = nav.parse(nav.build(chapters), text_col="ncx").drop("error")
    new = chapters.select("book", "ordinal", F.concat(F.upper("title"), F.lit("!")).alias("title"), F.concat(F.lit("OEBPS/chapter_"), F.col("ordinal").cast("string"), F.lit(".html#top")).alias("src"))
    return nav.retitle(entries, new)


@_query("""SELECT r_regionkey AS book, CAST(dense_rank() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS INT) AS chapter_index, CAST(sub AS INT) AS sub_index, CAST(CASE WHEN sub = 0 THEN 1 ELSE 2 END AS INT) AS level, title
  FROM (SELECT r_regionkey, n_nationkey, 0 AS sub, n_name AS title FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey), s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)""")
def toc_flatten(t):
    """A nested structure of regions, nations and suppliers as rows."""
    entry = lambda key, title, level: F.struct(F.col(key).alias("key"), F.col(title).alias("title"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"), F.lit(level).alias("level"))
    subs = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(entry("s_suppkey", "s_name", 2))).alias("subchapters"))
    chapters = t("nation").join(subs, "n_nationkey", "left")
    one = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"), F.lit(1).alias("start_page"), F.lit(2).alias("end_page"), F.lit(1).alias("level"), "subchapters")
    nested = chapters.groupBy(F.col("n_regionkey").alias("book")).agg(F.array_sort(F.collect_list(one)).alias("chapters"))
    return nav.flatten(nested).select("book", "chapter_index", "sub_index", "level", "title")


@_query("SELECT user_id, event_type AS last_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def progress_latest(t):
    return relational.last_by(t("events"), ["user_id"], ["ts", "event_id"], ["event_type"]).withColumnRenamed("event_type", "last_type")


_LOG = """(SELECT CAST(user_id % 7 AS VARCHAR) AS book, CAST(user_id AS VARCHAR) AS item, user_id AS ordinal, event_type = 'purchase' AS done FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'purchase' DESC) = 1)"""


def _log(t):
    done = F.col("event_type") == "purchase"
    return t("events").select(
        (F.col("user_id") % 7).cast("string").alias("book"), F.lit("chapter").alias("kind"), F.col("user_id").cast("string").alias("item"),
        F.col("user_id").alias("ordinal"), done.alias("done"), F.lit("").alias("content"), F.col("ts").alias("at"),
    )


@_query(f"SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT item FROM {_LOG} WHERE done)")
def resume_pending(t):
    """Customers as items, events as checkpoints: a purchase is done."""
    items = t("customer").select((F.col("c_custkey") % 7).cast("string").alias("book"), F.lit("chapter").alias("kind"), F.col("c_custkey").cast("string").alias("item"), "c_custkey")
    return progress.pending(items, _log(t)).select("c_custkey")


@_query(f"SELECT book, coalesce(max(ordinal) FILTER (WHERE done), -1) AS frontier FROM {_LOG} GROUP BY book")
def resume_frontier(t):
    return progress.frontier(_log(t)).select("book", "frontier")


@_query("SELECT doc_id, CAST(CASE WHEN n_chars <= 2000 THEN 0 WHEN n_chars * 0.6 <= 2000 THEN 1 WHEN n_chars * 0.4 <= 2000 THEN 2 WHEN n_chars * 0.25 <= 2000 THEN 3 ELSE -1 END AS INT) AS rung FROM documents")
def ladder_first_fit(t):
    return t("documents").select("doc_id", relational.first_fit(F.col("n_chars"), [1.0, 0.6, 0.4, 0.25], 2000.0).alias("rung"))


@_query("""SELECT doc_id, round(CASE WHEN o = 0 THEN NULL ELSE CAST(i AS DOUBLE) / o END, 6) AS ratio, round(CASE WHEN i = 0 THEN NULL ELSE CAST(i - o AS DOUBLE) / i * 100 END, 6) AS saved_pct
  FROM (SELECT doc_id, strlen(text) AS i, strlen(regexp_replace(text, '[aeiou]', '', 'g')) AS o FROM documents)""")
def size_stats(t):
    sizes = t("documents").select("doc_id", relational.size_stats(F.octet_length("text"), F.octet_length(F.translate("text", "aeiou", ""))).alias("s"))
    return sizes.select("doc_id", F.round("s.compression_ratio", 6).alias("ratio"), F.round("s.saved_percentage", 6).alias("saved_pct"))


@_query("SELECT n, round(least(pow(2, n) + 0.1 * n, 30), 6) AS seconds FROM (SELECT o_orderkey % 8 + 1 AS n FROM orders GROUP BY 1)")
def backoff_schedule(t):
    attempts = t("orders").select((F.col("o_orderkey") % 8 + 1).alias("n")).distinct()
    return attempts.select("n", F.round(T.backoff_seconds(F.col("n")), 6).alias("seconds"))


@_query(r"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s]+|[\s]+$', '', 'g')), chr(10))) AS md5 FROM documents")
def number_prefix_strip(t):
    """Lines that are numbered and stripped of their numbers again."""
    stripped = F.transform(T.lines(T.numbered(T.lines(F.col("text")))), T.strip_number)
    return t("documents").select("doc_id", F.md5(F.array_join(stripped, "\n")).alias("md5"))


@_query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'cli-' || n_name END, CASE WHEN n_nationkey % 2 = 0 THEN 'file-' || n_name END, 'default') AS value FROM nation")
def config_overlay(t):
    given = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("cli-"), "n_name"))
    file = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("file-"), "n_name"))
    return t("nation").select("n_nationkey", progress.overlay(given, file, F.lit("default")).alias("value"))


@_query("SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1")
def content_duplicates(t):
    return t("documents").groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def sync_tumbling_5m(t):
    """Files that a sync would hand over in each cycle of five minutes (an extension)."""
    return sync.tumbling(t("events"))


@_query("""WITH refs AS (SELECT DISTINCT page_id % 10 AS book, unnest(regexp_extract_all(html, '(?i)<img\\b[^>]*?\\bsrc\\s*=\\s*["''](?:\\.\\./)*images/([^"''#?]+)', 1)) AS name FROM pages
    UNION SELECT page_id % 10, 'p' || page_id || '.jpg' FROM pages WHERE page_id % 3 = 0)
  SELECT page_id % 10 AS book, 'p' || page_id || '.jpg' AS name FROM pages EXCEPT SELECT book, name FROM refs""".replace("\\\\", "\\"))
def asset_prune(t):
    """Each page brings an image; every third page shows its own. The others are unused."""
    book, name = (F.col("page_id") % 10).alias("book"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".jpg"))
    shown = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<img alt="x" src="../images/'), name, F.lit('"/>'))).otherwise(F.lit(""))
    html = t("pages").select(book, F.concat(F.lit("text/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.concat("html", shown).alias("content"))
    images = t("pages").select(book, F.concat(F.lit("images/"), name).alias("member"), F.lit("").alias("content"))
    return package.unused_images(html.unionByName(images)).select("book", "name")


@_query("""WITH img AS (SELECT source AS book, n AS page_no, doc_id FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n_chars % 2 = 0),
  b AS (SELECT source AS book, count(*) AS most FROM documents GROUP BY source),
  c AS (SELECT b.book, most, unnest(range(0, (most + 2) // 2)) AS chapter FROM b)
  SELECT c.book, chapter, md5(CASE WHEN doc_id IS NULL THEN '<p>a</p><div class="image-placeholder" id="i1" data-page="' || chapter % 5 || '" data-description="a plate"></div>'
    ELSE '<p>a</p><img src="../images/' || doc_id || '.jpg" alt="a plate" class="chapter-image" />' END || '<p>b</p>') AS md5
  FROM c LEFT JOIN img ON img.book = c.book AND img.page_no = least(chapter * 2 + 1 + chapter % 5, most)""")
def placeholder_fill(t):
    """Placeholders of all chapters of each book, two pages apart, filled from pages that have an image."""
    docs = t("documents").select(F.col("source").alias("book"), "doc_id", "n_chars")
    numbered = cut(relational.ordinals(docs, ["book"], ["doc_id"], "page_no"), "pages")
    n_pages = numbered.groupBy("book").agg(F.max("page_no").alias("n_pages"))
    images = numbered.where(F.col("n_chars") % 2 == 0).select("book", "page_no", F.lit(1).alias("image_no"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"))
    chapters = n_pages.select("book", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_pages") / 2).cast("long"))).alias("chapter"))
    mark = F.concat(F.lit('<div class="image-placeholder" id="i1" data-page="'), (F.col("chapter") % 5).cast("string"), F.lit('" data-description="a plate"></div>'))
    chapters = chapters.select("book", "chapter", (F.col("chapter") * 2 + 1).alias("start_page"), F.concat(F.lit("<p>a</p>"), mark, F.lit("<p>b</p>")).alias("html"))
    done = pages.fill_placeholders(chapters, images, n_pages)
    return done.select("book", "chapter", F.md5("html").alias("md5"))


_XHTML, _IMG = "application/xhtml+xml", "image/png"


@_query(f"""SELECT r_regionkey AS book, md5({package.opf_sql("r_name || ' & co'", "'id-' || r_regionkey", "'A &amp; B'", "'2020-01-01T00:00:00'")}) AS md5
  FROM (SELECT r_regionkey, r_name,
    string_agg('<item id="chapter_' || o || '" href="text/chapter_' || o || '.html" media-type="{_XHTML}"/>' || chr(10), '' ORDER BY o) AS items,
    string_agg('<item id="img_' || o || '" href="images/' || lpad(CAST(o AS VARCHAR), 3, '0') || '.png" media-type="{_IMG}"/>' || chr(10), '' ORDER BY o) AS pictures,
    string_agg('<itemref idref="chapter_' || o || '"/>' || chr(10), '' ORDER BY o) AS refs FROM {_CHAPTERS} JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)""")
def opf_assembly(t):
    """The whole package document: metadata, items, images and reading order."""
    chapters = cut(_chapters(t), "chapters")
    books = chapters.groupBy("book").agg(F.concat(F.min("book_title"), F.lit(" & co")).alias("title"), F.min("identifier").alias("identifier"))
    books = books.withColumns({"author": F.lit("A & B"), "cover": F.lit(None).cast("string")})
    images = chapters.select("book", F.concat(F.lpad(F.col("ordinal").cast("string"), 3, "0"), F.lit(".png")).alias("name"))
    images = images.unionByName(chapters.select("book", F.lit("x.txt").alias("name")))
    return package.build_opf(books, chapters, images, "2020-01-01T00:00:00").select("book", F.md5("opf").alias("md5"))


@_query("""SELECT CAST(page_id % 20 AS VARCHAR) AS book, 'text/' || page_id || '.html' AS member, md5(html) AS md5 FROM pages
  UNION ALL SELECT DISTINCT CAST(page_id % 20 AS VARCHAR), 'mimetype', md5('application/epub+zip') FROM pages""")
def archive_round_trip(t):
    """Pages packed into archives of twenty books and read back."""
    book = (F.col("page_id") % 20).cast("string").alias("book")
    html = t("pages").select(book, F.concat(F.lit("text/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.encode("html", "UTF-8").alias("content"))
    kind = html.select("book").distinct().select("book", F.lit("mimetype").alias("member"), F.encode(F.lit(package.MIMETYPE), "UTF-8").alias("content"))
    read = archive.members_of(archive.archives_of(html.unionByName(kind)))
    return read.select("book", "member", F.md5("content").alias("md5"))


@_query("""SELECT page_id, CASE WHEN html = '' THEN NULL ELSE md5(html) END AS md5, contains(html, '</html>') AS closed,
  CASE WHEN contains(html, '</html>') THEN CAST(greatest(1, (length(html) + 1999) // 2000) AS INT) ELSE 0 END AS calls FROM pages WHERE html IS NOT NULL""")
def translate_continue(t):
    """A generator that gives 2000 characters at a time is asked until the document closes, or adds nothing more."""
    whole = t("pages").where(F.col("html").isNotNull())
    items = whole.select(F.lit("b").alias("book"), F.col("page_id").alias("ordinal"), F.lit("").alias("member"), "html")
    done = G.translate_items(items, G.Truncating(G.Echo(), 2000), "Repeat.", G.Policy(1), more=None)
    closed = F.col("error").isNull()
    return done.select(F.col("ordinal").alias("page_id"), F.md5("response").alias("md5"), closed.alias("closed"), F.when(closed, F.col("calls")).otherwise(0).alias("calls"))


@_query("SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS ordinal, c_name AS title, upper(c_name) AS translated FROM customer")
def title_batches(t):
    """Titles in numbered batches of ten, answered in capitals and matched by number."""
    rows = relational.ordinals(t("customer").select(F.col("c_nationkey").cast("string").alias("book"), "c_custkey", F.col("c_name").alias("title")), ["book"], ["c_custkey"])
    done = G.translate_titles(rows, G.Echo(str.upper), "Translate.")
    return done.select(F.col("book").cast("int").alias("c_nationkey"), "ordinal", "title", "translated")


@_query(f"""WITH c AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/]+/([^/]*)', 1) AS book, {_CLEAN.format("html")} AS h FROM pages),
  o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id) AS n, coalesce(lag(left(h, 200)) OVER (PARTITION BY book ORDER BY page_id), '') AS ctx FROM c)
  SELECT book, page_id, 'chapter_' || n AS item_id, n + 2 AS play_order, CAST((n - 1) // 10 AS BIGINT) AS batch, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS title, md5(ctx) AS context_md5, md5(h) AS content_md5 FROM o""")
def translate_flow(t):
    """Responses cleaned, numbered and batched per book, with the start of the page before as context."""
    done = H.clean(t("pages"), "html").select("page_id", F.regexp_extract("url", "^[^:]*://[^/]+/([^/]*)", 1).alias("book"), F.col("cleaned.content").alias("h"))
    done = cut(done, "cleaned")  # numbering samples its input: cleaned once, and only keys are dealt by ranges
    numbers = cut(relational.batches(done.select("book", "page_id"), ["book"], ["page_id"]), "numbers")
    rows = done.join(numbers, ["book", "page_id"])
    # the page before by its number: a join of equals, where a window would hold a book in one task
    before = done.select("book", "page_id", F.left("h", F.lit(200)).alias("ctx")).join(numbers, ["book", "page_id"]).select("book", (F.col("ordinal") + 1).alias("ordinal"), "ctx")
    rows = rows.join(before, ["book", "ordinal"], "left")
    return rows.select(
        "book", "page_id", F.concat(F.lit("chapter_"), F.col("ordinal").cast("string")).alias("item_id"), (F.col("ordinal") + 2).alias("play_order"), "batch",
        H.title(F.col("h")).alias("title"), F.md5(F.coalesce("ctx", F.lit(""))).alias("context_md5"), F.md5("h").alias("content_md5"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["translate_flow"](spark, sf_dir)
