"""Cleaning and classification of model responses that should hold HTML, as column expressions.

A response ends as ``ok`` with the kind of match (full, body, div), as ``partial`` where a tag opens but nothing
closes, as ``invalid``, or as ``null_input``. Between passes only JSON envelopes and runs of newlines
change, so a fixed number of passes is a chain of expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import json_text, strip

# What counts as a document, and the fences around it.
FULL = r"(?s)(?:<\?xml.*?\?>)?(?:<!DOCTYPE.*?>)?(?:<html.*?>).*?</html>"
BODY = r"(?s)(?:<body.*?>).*?</body>"
DIV = r"(?s)<div.*?>.*?</div>"
OPENING = r"(?s)<(?:html|body|div).*?>"
FENCES = (r"(?U)```html\s*", r"(?U)```\s*$", r"(?U)```[a-zA-Z]*\s*")
KINDS = (("full", FULL, "</html>"), ("body", BODY, "</body>"), ("div", DIV, "</div>"))


def without_fences(text: Column) -> Column:
    out = text
    for fence in FENCES:
        out = F.regexp_replace(out, fence, "")
    return F.when(text.contains("```"), out).otherwise(text)


def first_match(text: Column) -> Column:
    """struct<kind, content> of the first kind that matches, or null. The closing tag is looked for
    first: without one a lazy pattern tries every pair of positions."""
    out = F.lit(None).cast("struct<kind:string,content:string>")
    for kind, pattern, closing in reversed(KINDS):
        found = F.regexp_extract(text, pattern, 0)
        out = F.when(text.contains(closing) & (found != ""), F.struct(F.lit(kind).alias("kind"), strip(found).alias("content"))).otherwise(out)
    return out


def merged(previous: Column, text: Column) -> Column:
    """The text alone where it holds a whole document or nothing came before; else both together."""
    whole = text.contains("</html>") & (F.regexp_extract(text, FULL, 0) != "")
    return F.when(F.coalesce(previous, F.lit("")) == "", text).when(whole, text).otherwise(F.concat(previous, text))


_OUT = "struct<status:string,match_kind:string,content:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _result(status: str, kind: Column, content: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), kind.alias("match_kind"), content.alias("content"))


def _pass(state: Column) -> Column:
    """One pass over struct<text, out>; a state with a result stays."""
    null = F.lit(None).cast("string")

    def judged(plain: Column) -> Column:
        def with_match(match: Column) -> Column:
            found = F.when(match.isNotNull(), _result("ok", match["kind"], match["content"])).when(plain.rlike(OPENING), _result("partial", null, plain))
            return F.struct(F.regexp_replace(plain, r"\n{2,}", "\n").alias("text"), found.alias("out"))

        return _let(first_match(plain), with_match)

    return F.when(state["out"].isNull() & state["text"].isNotNull(), _let(without_fences(json_text(state["text"])), judged)).otherwise(state)


def clean(frame: DataFrame, text_col: str, previous: Column | None = None, passes: int = 3, out_col: str = "cleaned") -> DataFrame:
    """Adds struct<status, match_kind, content>. No passes: null input and everything else alike is ``null_input``.

    The passes fold over a state, so the expression stays small where a filter on the result is pushed down.
    """
    text = F.col(text_col) if previous is None else merged(previous, F.col(text_col))
    null = F.lit(None).cast("string")
    nothing = _result("null_input", null, null)
    if not passes:
        return frame.withColumn(out_col, nothing)
    first = F.struct(text.alias("text"), F.lit(None).cast(_OUT).alias("out"))
    steps = F.sequence(F.lit(1), F.lit(passes))
    missing = F.when(text.isNull(), nothing).otherwise(_result("invalid", null, null))
    return frame.withColumn(out_col, F.aggregate(steps, first, lambda state, _: _pass(state), lambda state: F.coalesce(state["out"], missing)))


def references(html: Column, strict: bool = False) -> Column:
    """Image names that a page refers to; strict: only ``src`` first, in double quotes, under ``../images/``."""
    pattern = r'<img src="\.\./images/([^"]+)"' if strict else r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["'](?:\.\./)*images/([^"'#?]+)"""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
