"""Scalar text functions as columns. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as in Unicode, which the JVM's classes cover only with (?U).
_SPACE_ENDS = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end (``trim`` removes U+0020 only)."""
    return F.regexp_replace(text, _SPACE_ENDS, "")


def strip_number(line: Column) -> Column:
    """Without a leading ``N. ``, with digits of any script, and stripped."""
    return strip(F.regexp_replace(line, r"(?U)^\d+\.\s*", ""))


def lines(text: Column) -> Column:
    """Split on newlines, blank lines kept."""
    return F.split(text, "\n", -1)


def numbered(items: Column) -> Column:
    """``1. first`` and so on, one line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x, F.lit("")))), "\n")


def basename(path: Column, keep_fragment: bool = False) -> Column:
    """The last part of a path; a ``#fragment`` goes first unless it is to be kept."""
    plain = path if keep_fragment else F.substring_index(path, "#", 1)
    return F.substring_index(plain, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def title_or_stem(title: Column, path: Column) -> Column:
    """An empty or missing title falls back to the file's stem."""
    return F.coalesce(F.nullif(title, F.lit("")), stem(path))


def prefix(text: Column, n: int) -> Column:
    """The first n characters; n of 0 or less gives the empty string."""
    return F.left(text, F.lit(max(n, 0)))


def preview(text: Column, n: int = 500) -> Column:
    """Head and tail, for logs."""
    return F.concat(F.left(text, F.lit(n)), F.lit("\n ... \n"), F.right(text, F.lit(n)))


def escape_xml(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape_xml(text: Column) -> Column:
    for plain, entity in ((">", "&gt;"), ("<", "&lt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def quoted_replacement(text: Column) -> Column:
    """``text`` as a replacement that stands for itself."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def replace_element(text: Column, tag: str, value: Column) -> Column:
    """Every ``<tag>…</tag>`` on one line gets the value as its text, taken literally."""
    whole = F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    return F.regexp_replace(text, F.lit(f"<{tag}>.*?</{tag}>"), quoted_replacement(whole))


def pages_between(first: Column, last: Column) -> Column:
    """All whole numbers from first to last; empty where first is above last or either is null."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def backoff_seconds(attempt: Column, cap: float = 30.0) -> Column:
    """Wait before an attempt: 2^n and a tenth of n, up to the cap."""
    return F.least(F.pow(F.lit(2.0), attempt) + F.lit(0.1) * attempt, F.lit(cap))


def megabytes(size: Column) -> Column:
    return size / F.lit(1048576.0)


def json_text(text: Column) -> Column:
    """What a JSON envelope holds: a JSON string's value, or the string in an object's field ``html``; other texts as they are."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    inner = F.try_variant_get(value, "$.html", "string")
    opened = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("OBJECT"), inner)
    return F.when(text.rlike(r'^\s*["{]'), F.coalesce(opened, text)).otherwise(text)


def utc_stamp(moment: Column) -> Column:
    """ISO form, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
