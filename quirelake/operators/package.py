"""The package document of a book, its fixed members, and the pruning of images that nothing refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.html import references
from quirelake.functions.text import basename, escape_xml, replace_element
from quirelake.operators.relational import missing_from, ordinals

# Fixed values of the format.
MIMETYPE = "application/epub+zip"
CONTAINER = (
    '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)
IMAGE_TYPES = (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"))
STYLESHEET = "body { margin: 5%; line-height: 1.6 }\nimg { max-width: 100%; height: auto }\nh1, h2 { text-align: center }\n"


def image_class(name: Column) -> Column:
    """Rank of an image by its extension, null for other files."""
    out = F.lit(None).cast("int")
    for rank, (extension, _) in enumerate(IMAGE_TYPES):
        out = F.when(F.lower(name).endswith("." + extension), F.lit(rank)).otherwise(out)
    return out


def manifest_images(images: DataFrame) -> DataFrame:
    """Images (book, name) with item_id: numbered from 1 by class, then name, over the classes together."""
    ranked = images.withColumn("class", image_class(F.col("name"))).where(F.col("class").isNotNull())
    return ordinals(ranked, ["book"], ["class", "name"], "item_id")


def referenced_images(members: DataFrame, strict: bool = False) -> DataFrame:
    """book, name: images that pages, the title page or the package's cover item refer to. Members have book, member, content (text)."""
    text = F.col("content").cast("string")
    page = F.col("member").rlike(r"\.html$") if strict else F.col("member").rlike(r"(?i)\.x?html?$")
    found = members.where(page).select("book", F.explode(references(text, strict)).alias("name"))
    cover = F.regexp_extract(text, r'<item (?=[^>]*\bid="cover")[^>]*\bhref="([^"]+)"', 1)
    opf = members.where(F.col("member").endswith("content.opf")).select("book", cover.alias("name")).where(F.col("name") != "")
    title = members.where(F.col("member").endswith("titlepage.xhtml")).select("book", F.explode(F.regexp_extract_all(text, F.lit(r'<ima?ge?\b[^>]*?(?:xlink:href|src)="([^"]+)"'), F.lit(1))).alias("name"))
    return found.unionByName(opf).unionByName(title).select("book", basename(F.col("name")).alias("name")).distinct()


def unused_images(members: DataFrame, strict: bool = False) -> DataFrame:
    """book, member, name of images that nothing refers to."""
    images = members.where(F.col("member").rlike(r"(^|/)images/[^/]+\.[^/]+$")).select("book", "member", basename(F.col("member"), True).alias("name"))
    return missing_from(images, referenced_images(members, strict), ["book", "name"])


def pruned(members: DataFrame, strict: bool = False) -> DataFrame:
    """Members without unused images; run before the manifest is written, so that it lists what is there."""
    return missing_from(members, unused_images(members, strict), ["book", "member"])


def _item(id_: Column, href: Column, kind: Column | str) -> Column:
    return F.concat(F.lit('<item id="'), id_, F.lit('" href="'), escape_xml(href), F.lit('" media-type="'), F.lit(kind) if isinstance(kind, str) else kind, F.lit('"/>\n'))


def _layout(title, identifier, author, stamp, cover, items, pictures, refs, language: str, direction: str) -> list:
    """The package document as fixed texts and parts, in order."""
    page = "application/xhtml+xml"
    return [
        '<?xml version="1.0" encoding="utf-8"?>\n<package version="2.0" xmlns="http://www.idpf.org/2007/opf" unique-identifier="bookid">\n',
        '<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n<dc:identifier id="bookid">', identifier, "</dc:identifier>\n<dc:title>", title, "</dc:title>\n",
        f"<dc:language>{language}</dc:language>\n<dc:creator>", author, "</dc:creator>\n<dc:date>", stamp, '</dc:date>\n<meta name="cover" content="cover"/>\n</metadata>\n',
        '<manifest>\n<item id="nav" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n<item id="style" href="stylesheet.css" media-type="text/css"/>\n',
        cover, f'<item id="front" href="titlepage.xhtml" media-type="{page}"/>\n<item id="contents" href="text/toc.html" media-type="{page}"/>\n', items, pictures,
        f'</manifest>\n<spine toc="nav" page-progression-direction="{direction}">\n<itemref idref="front"/>\n<itemref idref="contents"/>\n', refs, "</spine>\n</package>\n",
    ]


def build_opf(books: DataFrame, chapters: DataFrame, images: DataFrame, stamp: str, language: str = "en", direction: str = "ltr") -> DataFrame:
    """book, opf. Books have book, title, author, identifier, cover; chapters book, ordinal; images book, name."""
    id_ = F.concat(F.lit("chapter_"), F.col("ordinal").cast("string"))
    own = F.struct("ordinal", _item(id_, F.concat(F.lit("text/"), id_, F.lit(".html")), "application/xhtml+xml").alias("item"), F.concat(F.lit('<itemref idref="'), id_, F.lit('"/>\n')).alias("ref"))
    by_book = chapters.groupBy("book").agg(F.array_sort(F.collect_list(own)).alias("c"))
    kind = F.element_at(F.array(*[F.lit(t) for _, t in IMAGE_TYPES]), F.col("class") + 1)
    picture = F.struct("item_id", _item(F.concat(F.lit("img_"), F.col("item_id").cast("string")), F.concat(F.lit("images/"), F.col("name")), kind).alias("item"))
    pictures = manifest_images(images).groupBy("book").agg(F.array_sort(F.collect_list(picture)).alias("i"))
    rows = books.join(by_book, "book", "left").join(pictures, "book", "left")
    text = lambda column, field: F.coalesce(F.array_join(F.transform(column, lambda x: x[field]), ""), F.lit(""))
    plain = lambda c: escape_xml(F.coalesce(F.col(c), F.lit("")))
    cover = F.when(F.col("cover").isNotNull(), _item(F.lit("cover"), F.col("cover"), "image/jpeg")).otherwise(F.lit(""))
    parts = _layout(plain("title"), plain("identifier"), plain("author"), F.lit(stamp), cover, text(F.col("c"), "item"), text(F.col("i"), "item"), text(F.col("c"), "ref"), language, direction)
    return rows.select("book", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("opf"))


class _Sql(str):
    """A part of the layout that is SQL, not text."""


def opf_sql(title: str, identifier: str, author: str, stamp: str, language: str = "en", direction: str = "ltr") -> str:
    """The document of a book without a cover as a SQL expression over columns items, pictures and refs."""
    escaped = f"replace(replace(replace({title}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    parts = _layout(*map(_Sql, (escaped, identifier, author, stamp, "''", "items", "pictures", "refs")), language, direction)
    return " || ".join(p if isinstance(p, _Sql) else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for p in parts)


def retitled_opf(opf: Column, title: Column) -> Column:
    """The package document with another title, escaped and taken literally."""
    return replace_element(opf, "dc:title", escape_xml(title))


def title_page(cover: Column, width: Column, height: Column) -> Column:
    """A page that shows the cover, in its proportions where its size is known."""
    size = F.when(width.isNotNull() & height.isNotNull(), F.concat(F.lit("aspect-ratio: "), width.cast("string"), F.lit(" / "), height.cast("string"), F.lit("; "))).otherwise(F.lit(""))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><title>Cover</title><style>img { '), size, F.lit("max-height: 100% }</style></head>\n"),
        F.lit('<body><p><img alt="Cover" src="'), escape_xml(cover), F.lit('"/></p></body>\n</html>\n'),
    )


def fixed_members(books: DataFrame) -> DataFrame:
    """book, member, content of the members that every archive has alike."""
    same = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(c).alias("content")) for m, c in (("mimetype", MIMETYPE), ("META-INF/container.xml", CONTAINER), ("stylesheet.css", STYLESHEET))])
    return books.select("book", F.explode(same).alias("x")).select("book", "x.member", "x.content")
