"""Tables of contents: reading, building and retitling navigation documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import basename, escape_xml
from quirelake.operators.relational import first_match

UNTITLED = "Unknown Title"
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", re.S)
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)(\w+);")


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _tree(raw: str) -> ET.Element:
    """The root, without the document type (nothing is fetched) and with HTML entities resolved."""
    from html import unescape

    plain = _DOCTYPE.sub("", raw.lstrip("﻿ \t\r\n"))
    plain = _ENTITY.sub(lambda m: unescape(m[0]).replace("&", "&amp;"), plain)
    return ET.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", plain))


def _below(element: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in element.iter() if e is not element and _local(e.tag) == name), None)


def read_points(raw: str) -> list[tuple[str | None, str | None]]:
    """(title, src) of every entry at any depth, in document order. An entry without any content is left out; one
    without a label of its own takes the first below it; a label without text has a null title."""
    out = []
    for point in _tree(raw).iter():
        if _local(point.tag) != "navPoint":
            continue
        own = next((c for c in point if _local(c.tag) == "content"), None)
        content = own if own is not None else _below(point, "content")
        if content is None:
            continue
        label = _below(point, "navLabel")
        text = next((c for c in label if _local(c.tag) == "text"), None) if label is not None else None
        out.append((text.text if text is not None else UNTITLED, content.get("src")))
    return out


def parse(docs: DataFrame, book: str = "book", text_col: str = "content") -> DataFrame:
    """book, nav_ord (from 1), title, src, error: one row per entry, or one row with the error of a document that can't be read."""
    kind = docs.schema[book].dataType.simpleString()

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for key, raw in zip(pdf["k"], pdf["t"], strict=True):
                try:
                    rows += [(key, i, title, src, None) for i, (title, src) in enumerate(read_points(raw), 1)]
                except (ET.ParseError, TypeError, AttributeError) as problem:
                    rows.append((key, None, None, None, str(problem) or "no text"))
            yield pd.DataFrame(rows, columns=["k", "nav_ord", "title", "src", "error"]).astype({"nav_ord": "Int64"})

    plain = docs.select(F.col(book).alias("k"), F.col(text_col).cast("string").alias("t"))
    return plain.mapInPandas(read, f"k {kind}, nav_ord long, title string, src string, error string").withColumnRenamed("k", book)


def retitle(entries: DataFrame, translated: DataFrame) -> DataFrame:
    """``entries`` (book, nav_ord, title, src) with the title of the first translated entry (book, src, title, ordinal) of the
    same source, else of the same file name with its fragment, else of the same file name; no match keeps the title."""
    out, found = entries, []
    ways = (lambda c: c, lambda c: basename(c, True), basename)
    for i, way in enumerate(ways):
        new = translated.select("book", way(F.col("src")).alias(f"_s{i}"), "ordinal", F.col("title").alias(f"_t{i}"))
        out = first_match(out.withColumn(f"_s{i}", way(F.col("src"))), new, ["book", f"_s{i}"], ["ordinal"], [f"_t{i}"])
        found.append(f"_t{i}")
    return out.withColumn("title", F.coalesce(*found, "title")).select(*entries.columns)


def with_titles(raw: str, titles: list[tuple[str, str]]) -> str:
    """The document with new label texts by source: whole, else by file name with its fragment; all else stays, nesting, head and
    document type included."""
    names = lambda src: src.rpartition("/")[2]
    whole, named = {}, {}
    for src, title in titles:
        whole.setdefault(src, title)
        named.setdefault(names(src), title)
    root = _tree(raw)
    for point in root.iter():
        if _local(point.tag) != "navPoint":
            continue
        content = next((c for c in point if _local(c.tag) == "content"), None)
        src = content.get("src") if content is not None else None
        title = whole.get(src, named.get(names(src))) if src is not None else None
        label = _below(point, "text")
        if title is not None and label is not None:
            label.text = title
    space = root.tag.partition("}")[0][1:] if root.tag.startswith("{") else None
    if space:
        ET.register_namespace("", space)
    kind = _DOCTYPE.search(raw)
    head = '<?xml version="1.0" encoding="utf-8"?>\n' + (f"{kind[0]}\n" if kind else "")
    return head + ET.tostring(root, encoding="unicode")


def retitled(docs: DataFrame, titles: DataFrame) -> DataFrame:
    """book, member, ncx: navigation documents (book, member, content) with the titles (book, ordinal, src, title) of their book."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "src", "title"))), lambda x: F.struct(x["src"].alias("src"), x["title"].alias("title")))
    by_book = titles.where(F.col("src").isNotNull() & F.col("title").isNotNull()).groupBy("book").agg(listed.alias("titles"))

    @F.pandas_udf("string")
    def renamed(raw: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([with_titles(t, [(x["src"], x["title"]) for x in found]) if found is not None else t for t, found in zip(raw, lists, strict=True)], dtype=object)

    both = docs.select("book", "member", F.col("content").cast("string").alias("t")).join(by_book, "book", "left")
    return both.select("book", "member", renamed("t", "titles").alias("ncx"))


def build(chapters: DataFrame, book: str = "book", language: str = "en", cover: str = "Cover", contents: str = "Contents") -> DataFrame:
    """book, ncx: the navigation document. Chapters have book, book_title, identifier, ordinal (from 1), title.

    The cover plays first, the contents second, chapters from the third on.
    """
    point = lambda id_, order, label, src: F.concat(
        F.lit('<navPoint id="'), id_, F.lit('" playOrder="'), order, F.lit('"><navLabel><text>'), label, F.lit('</text></navLabel><content src="'), src, F.lit('"/></navPoint>\n')
    )
    number = F.col("ordinal").cast("string")
    own = point(F.concat(F.lit("chapter_"), number), (F.col("ordinal") + 2).cast("string"), escape_xml(F.coalesce("title", F.lit(""))), F.concat(F.lit("text/chapter_"), number, F.lit(".html")))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", own.alias("point"))))
    body = F.array_join(F.transform(listed, lambda x: x["point"]), "")
    rows = chapters.groupBy(book).agg(F.min("book_title").alias("_title"), F.min("identifier").alias("_id"), body.alias("_body"))
    fixed = [point(F.lit(i), F.lit(o), F.lit(t), F.lit(s)) for i, o, t, s in (("cover", "1", cover, "titlepage.xhtml"), ("toc", "2", contents, "text/toc.html"))]
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1" xml:lang="{language}">\n<head><meta name="dtb:uid" content="'),
        escape_xml(F.col("_id")), F.lit('"/></head>\n<docTitle><text>'), escape_xml(F.col("_title")), F.lit("</text></docTitle>\n<navMap>\n"),
    )
    return rows.select(book, F.concat(head, *fixed, F.col("_body"), F.lit("</navMap>\n</ncx>\n")).alias("ncx"))


def flatten(structures: DataFrame, book: str = "book") -> DataFrame:
    """book, chapter_index, sub_index (0 for the chapter itself), level, title, start_page, end_page of a nested structure."""
    chapter = structures.select(book, F.posexplode("chapters").alias("_i", "_c"))
    fields = lambda c: [F.col(f"{c}.{n}").alias(n) for n in ("level", "title", "start_page", "end_page")]
    top = chapter.select(book, (F.col("_i") + 1).alias("chapter_index"), F.lit(0).alias("sub_index"), *fields("_c"))
    sub = chapter.select(book, (F.col("_i") + 1).alias("chapter_index"), F.posexplode("_c.subchapters").alias("_j", "_s"))
    return top.unionByName(sub.select(book, "chapter_index", (F.col("_j") + 1).alias("sub_index"), *fields("_s")))


def contents_html(entries: DataFrame, book: str = "book", heading: str = "Contents") -> DataFrame:
    """book, html: a contents page from entries (book, ordinal, level, title, href)."""
    line = F.concat(F.lit('<li class="level-'), F.coalesce("level", F.lit(1)).cast("string"), F.lit('"><a href="'), escape_xml(F.col("href")), F.lit('">'), escape_xml(F.coalesce("title", F.lit(""))), F.lit("</a></li>\n"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))
    body = F.array_join(F.transform(listed, lambda x: x["line"]), "")
    page = F.concat(F.lit(f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{heading}</title></head><body><h1>{heading}</h1><ol>\n'), body, F.lit("</ol></body></html>"))
    return entries.groupBy(book).agg(page.alias("html"))
