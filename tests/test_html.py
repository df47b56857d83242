"""What responses hold, against a plain reading of the rules."""

import json
import re

import pytest

from quirelake.functions import html as H
from quirelake.functions import text as T

F = pytest.importorskip("pyspark.sql.functions")


def plain(text, previous=None, passes=3):
    """status, kind, content."""
    patterns = [("full", r"(?:<\?xml.*?\?>)?(?:<!DOCTYPE.*?>)?(?:<html.*?>).*?</html>"), ("body", r"(?:<body.*?>).*?</body>"), ("div", r"<div.*?>.*?</div>")]
    if text is None or not passes:
        return "null_input", None, None
    if previous and not re.search(patterns[0][1], text, re.S):
        text = previous + text
    for _ in range(passes):
        try:
            value = json.loads(text)
            text = value if isinstance(value, str) else value["html"] if isinstance(value, dict) and isinstance(value.get("html"), str) else text
        except json.JSONDecodeError:
            pass
        for fence in (r"```html\s*", r"```\s*$", r"```[a-zA-Z]*\s*"):
            text = re.sub(fence, "", text)
        for kind, pattern in patterns:
            found = re.search(pattern, text, re.S)
            if found:
                return "ok", kind, found[0].strip()
        if re.search(r"<(html|body|div).*?>", text, re.S):
            return "partial", None, text
        text = re.sub(r"\n{2,}", "\n", text)
    return "invalid", None, None


DOC = '<?xml version="1.0"?><!DOCTYPE html><html lang="x"><body>\n<div>é</div></body></html>'
CASES = [
    (None, None), ("", None), ("plain words", None), (DOC, None), ("before " + DOC + " after", None), ("<?xml?>\n<!DOCTYPE x>\n" + DOC[36:], None), ("```html\n" + DOC + "\n```", None),
    ("```xml\n" + DOC + "\n```\n", None), ("``` \n<body a='1'>b</body>\n```", None), ("<body>x</body> <div>y</div>", None), ("<div><div>in</div>out</div>", None), ("<html><body><div>cut", None), ("<html><div>a</div> cut", None),
    ("<HTML><BODY></BODY></HTML>", None), ("<body", None), ("</html>", None), ("<html", None), ("x</html><div>a</div>", None), (json.dumps(DOC), None), (json.dumps({"html": DOC}), None), (json.dumps({"html": 5}), None), (json.dumps({"other": DOC}), None),
    (json.dumps(json.dumps(DOC)), None), (json.dumps(json.dumps(json.dumps({"html": "<div>z</div>"}))), None), (json.dumps(json.dumps(json.dumps(json.dumps("<div>z</div>")))), None), ("  " + json.dumps("<div>s</div>"), None), ("[1, 2]", None), ("5", None),
    ("<p>end</p></div></body></html>", "<html><body><div>start"), (DOC, "<html><body>old"), ("more", "<div>a"), (" b</div>", "<div>a"), (None, "<div>a"), ("", "<div>a</div>"), ("\n\n\n\"<div>\n\n</div>\"", None), ("\u3000<div>q</div>\u3000", None), ("<div>" + "x" * 100_000, None),
]


@pytest.mark.parametrize("passes", [0, 1, 3])
def test_clean(spark, passes):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(CASES)], "i int, t string, p string")
    got = {r.i: tuple(r.cleaned) for r in H.clean(df, "t", F.col("p"), passes).collect()}
    for i, (t, p) in enumerate(CASES):
        assert got[i] == plain(t, p, passes), (t[:80] if t else t, p)


def test_text_functions(spark):
    rows = [(" \u3000a\n ", "１２. Ｘ", "a/b/c.tar.gz#x", "Q $1 \\2 & <é>"), ("", "1.", ".hidden", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = df.select(
        T.strip(F.col("a")), T.strip_number(F.col("b")), T.basename(F.col("c")), T.basename(F.col("c"), True), T.stem(F.col("c")), T.title_or_stem(F.col("a"), F.col("c")), T.escape_xml(F.col("d")),
        T.replace_element(F.lit("<t>old</t><t>\n</t><t a=''>x</t>"), "t", F.col("d")),
    ).collect()
    assert tuple(got[0]) == ("a", "Ｘ", "c.tar.gz", "c.tar.gz#x", "c.tar", " \u3000a\n ", "Q $1 \\2 &amp; &lt;é&gt;", "<t>Q $1 \\2 & <é></t><t>\n</t><t a=''>x</t>")
    assert tuple(got[1])[:6] == ("", "", ".hidden", ".hidden", ".hidden", ".hidden") and set(got[2]) == {None}


def test_numbers(spark):
    df = spark.createDataFrame([(1, 3), (3, 1), (2, 2), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(T.pages_between(F.col("a"), F.col("b"))).collect()] == [[1, 2, 3], [], [2], []]
    assert [round(r[0], 6) for r in spark.range(1, 7).select(T.backoff_seconds(F.col("id"))).collect()] == [2.1, 4.2, 8.3, 16.4, 30.0, 30.0]
    items = spark.createDataFrame([(["x", None, "z"],), ([],)], "l array<string>")
    assert [r[0] for r in items.select(T.numbered(F.col("l"))).collect()] == ["1. x\n2. \n3. z", ""]


def test_references(spark):
    page = '<img src="../images/a.jpg"><img alt="" src="../images/b.png"><img src=\'images/c.jpg\'><IMG SRC="../images/d.jpg#f">'
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(H.references(F.col("h"), True)).first()[0] == ["a.jpg"]
    assert df.select(H.references(F.col("h"))).first()[0] == ["a.jpg", "b.png", "c.jpg", "d.jpg"]
