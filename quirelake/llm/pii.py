"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for bank account
numbers), context words beside a span adjust its score. Spans of the base kinds that pass their
test stay whatever their score; the added kinds need ``threshold``.

The patterns repeat single characters only, never groups (but for a bank account's few blocks of four): a matcher in the
JVM recurses on repeated groups and would exhaust its stack on a long run. What a group would test is masked out of the
text beforehand by replacing single characters by single characters, which keeps all positions.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk the
same matches, so their lengths, summed in order, are the spans. Sums go over groups of ``_STEP`` matches and then within each.
A piece of the text is taken from blocks of ``_BLOCK`` characters, since a substring walks a text from its start. So the
work grows with the text and its matches, never with their product.

Defined results: a null text counts as empty: no spans, the hash of the empty string; ``redact`` leaves it null. Null ids and
repeated rows are kept as they are, an empty table gives no rows. Other columns are passed on; working columns get names
that none of them has. No shuffle; a very long text is one row of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.session import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

# Context words and scores by kind (score without context, gain by context).
CONTEXT = {
    "email": r"(?i)\b(mail|e-mail|email|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|address|login|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|telefon|fax|telephone)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(ssn|social security|social-security|tax id)\b",
}
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5)}
THRESHOLD = 0.6
WINDOW = 40  # characters looked at on either side
_STEP = 128
_BLOCK = 1024
_SPANS = "array<struct<start:bigint,end:bigint,found:string>>"

_LABEL = "A-Za-z0-9-"
_LOCAL = r"A-Za-z0-9._%+\x01-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.[A-Za-z0-9.-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x20-]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


def _dots_masked(text: Column) -> Column:
    """A dot that no label follows becomes U+0001, which only local parts may hold."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), rf"\.(?![{_LABEL}])", "\x01")


def _separators_masked(text: Column) -> Column:
    """A space or hyphen that is not between two digits becomes a letter."""
    return F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")


def _spans(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, as array<struct<start, end, found>> in code points."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    widths = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), found,
        lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("m")),
    )
    return F.when(F.size(found) > 0, widths).otherwise(F.array().cast("array<struct<gap:bigint,len:bigint,m:string>>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, start: Column, step) -> Column:
    """For each value, ``step`` folded over those before it, from ``start``."""
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, first, lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _placed(widths: Column) -> Column:
    """start, end and text of each match, by running sums over what ``_spans`` gives."""
    zero = F.lit(0).cast("long")
    groups = F.sequence(F.lit(0), F.floor((F.size(widths) - 1) / _STEP).cast("int"))
    part = lambda g: F.slice(widths, g * _STEP + 1, F.lit(_STEP))
    sums = F.transform(groups, lambda g: F.aggregate(part(g), zero, lambda a, w: a + w["gap"] + w["len"]))

    def group(g: Column, before: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            start = acc["at"] + w["gap"]
            span = F.struct(start.alias("start"), (start + w["len"]).alias("end"), w["m"].alias("found"))
            return F.struct((start + w["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        first = F.struct(F.element_at(before, g + 1).alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(part(g), first, step, lambda acc: acc["out"])

    all_groups = _let(_before(sums, zero, lambda a, v: a + v), lambda before: F.flatten(F.transform(groups, lambda g: group(g, before))))
    return F.when(F.size(widths) > 0, all_groups).otherwise(F.array().cast(_SPANS))


def _blocks(text: Column) -> Column:
    """The text in pieces of ``_BLOCK`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, first: Column, last: Column) -> Column:
    """Characters first to last, the latter exclusive, of the text that the blocks make up."""
    at = F.floor(first / _BLOCK)
    some = F.array_join(F.slice(blocks, (at + 1).cast("int"), (F.floor((last - 1) / _BLOCK) - at + 1).cast("int")), "")
    return F.when(last > first, F.substring(some, (first - at * _BLOCK + 1).cast("int"), (last - first).cast("int"))).otherwise(F.lit(""))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _ip_valid(found: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(F.substring(part(p), 1, 3), 3, "0") <= "255"))


def _card_valid(found: Column) -> Column:
    digits = _digits(found)
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19))


def _phone_valid(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def _iban_valid(found: Column) -> Column:
    """mod-97 over the number with its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))
    code = lambda c: F.ascii(c)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, c: F.when(c == "", a).when(code(c) >= 65, (a * 100 + code(c) - 55) % 97).otherwise((a * 10 + code(c) - 48) % 97),
    )
    return F.length(plain).between(15, 34) & (rest == 1)


def _ssn_valid(found: Column) -> Column:
    area = F.substring(found, 1, 3)
    return ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(found, 5, 2) != "00") & (F.substring(found, 8, 4) != "0000")


# kind -> (cheap test of the whole text, text to search, pattern, test of a match)
_RULES = {
    "email": (lambda t: t.contains("@"), _dots_masked, _EMAIL, lambda m: F.lit(True)),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda t: t, _IP, _ip_valid),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _separators_masked, _CARD, _card_valid),
    "phone": (lambda t: t.rlike(r"\+[0-9]"), lambda t: t, _PHONE, _phone_valid),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), lambda t: t, _IBAN, _iban_valid),
    "ssn": (lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda t: t, _SSN, _ssn_valid),
}


def _rated(widths: Column, blocks: Column, kind: str, rank: int, window: int) -> Column:
    """The spans of a kind that pass its test, with their scores."""
    valid, (plain, gain) = _RULES[kind][3], SCORES[kind]

    def scored(s: Column) -> Column:
        around = _piece(blocks, F.greatest(s["start"] - window, F.lit(0).cast("long")), s["end"] + window)  # past the end there is nothing
        score = F.when(around.rlike(CONTEXT[kind]), F.lit(plain + gain)).otherwise(F.lit(plain))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.transform(F.filter(_placed(widths), lambda s: valid(s["found"])), scored)


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, window: int = WINDOW, name: str = "pii", blocks_name: str | None = None) -> DataFrame:
    """``docs`` with ``name``: array<struct<start, rank, end, kind, score>> sorted by start, then kind, and, if asked for, the
    text's blocks (null without spans). ``name`` must not be there already."""
    text, out, scratch = F.coalesce(F.col(text_col), F.lit("")), docs, []
    names = fresh(docs.withColumn(name, F.lit(0)), *[f"{p}_{k}" for p in ("w", "s") for k in KINDS], blocks_name or "blocks")
    widths, spans, blocks = dict(zip(KINDS, names, strict=False)), dict(zip(KINDS, names[len(KINDS) :], strict=False)), names[-1]
    scratch = names[:-1]
    empty = F.array().cast("array<struct<gap:bigint,len:bigint,m:string>>")
    for kind in KINDS:
        gate, masked, pattern, _ = _RULES[kind]
        out = out.withColumn(widths[kind], F.when(gate(text), _spans(masked(text), pattern)).otherwise(empty))
    some = F.greatest(*[F.size(widths[k]) for k in KINDS]) > 0
    out = out.withColumn(blocks, F.when(some, _blocks(text)))
    for rank, kind in enumerate(KINDS):
        rated = _rated(F.col(widths[kind]), F.col(blocks), kind, rank, window)
        if kind in ADDED_KINDS:
            rated = F.filter(rated, lambda s: s["score"] >= threshold)
        out = out.withColumn(spans[kind], rated)
    out = out.withColumn(name, F.array_sort(F.concat(*[F.col(spans[k]) for k in KINDS])))
    out = out.withColumnRenamed(blocks, blocks_name) if blocks_name else out.drop(blocks)
    return out.drop(*scratch)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each run of overlapping spans in the text replaced by ``[KIND]`` of its first span."""
    name, blocks = fresh(docs, "pii", "blocks")
    found = find_pii(docs, text_col, name=name, blocks_name=blocks)
    spans, text, zero = F.col(name), F.col(text_col), F.lit(0).cast("long")
    groups = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _STEP).cast("int"))
    part = lambda g: F.slice(spans, g * _STEP + 1, F.lit(_STEP))
    farthest = lambda items, start: F.aggregate(items, start, lambda a, s: F.greatest(a, s["end"]))

    def group(g: Column, before: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            new = F.concat(_piece(F.col(blocks), acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(new))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        first = F.struct(F.element_at(before, g + 1).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(part(g), first, step, lambda acc: acc["out"])

    ends = F.transform(groups, lambda g: farthest(part(g), zero))
    pieces = _let(_before(ends, zero, F.greatest), lambda before: F.flatten(F.transform(groups, lambda g: group(g, before))))
    clean = F.concat(F.array_join(pieces, ""), _piece(F.col(blocks), farthest(spans, zero), F.length(text).cast("long")))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, counts by base kind, hash of the base spans, all spans, and their scores in tenths."""
    found = find_pii(docs.select(F.col(id_col).alias("k"), "text"))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"] * 10).cast("int").cast("string")), ",")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select(F.col("k").alias(id_col), *map(of, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def oracle() -> str:
    """The query in DuckDB SQL, with the plain patterns. A social security number is a whole run of digits and hyphens."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "ssn": r"[0-9-]+",
    }
    digits = "regexp_replace(f, '[^0-9]', '', 'g')"
    digit = f"CAST(substr({digits}, len({digits}) - j, 1) AS INT)"
    luhn = f"list_sum(list_transform(range(0, len({digits})), lambda j: CASE WHEN j % 2 = 0 THEN {digit} ELSE {digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    plain = "replace(f, ' ', '')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    values = f"list_prepend(0, list_transform(string_split({turned}, ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END))"
    tests = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(f, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND lpad(ltrim(p, '0'), 3, '0') <= '255'))",
        "card": f"len({digits}) BETWEEN 12 AND 19 AND {luhn}", "phone": f"len({digits}) BETWEEN 9 AND 15",
        "iban": f"len({plain}) BETWEEN 15 AND 34 AND list_reduce({values}, lambda a, b: CASE WHEN b > 9 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1",
        "ssn": "regexp_matches(f, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') AND f[1:3] NOT IN ('000', '666') AND f[1] <> '9' AND f[5:6] <> '00' AND f[8:11] <> '0000' "
        + f"AND regexp_matches(substr(x, greatest(s - {WINDOW}, 0) + 1, s + len(f) + {WINDOW} - greatest(s - {WINDOW}, 0)), '{CONTEXT['ssn']}')",
    }
    found = " UNION ALL ".join(f"SELECT r, x, '{k}' AS kind, {i} AS rank, regexp_extract_all(x, '{p}') AS m, string_split_regex(x, '{p}') AS g FROM t" for i, (k, p) in enumerate(patterns.items()))
    valid = " ".join(f"WHEN '{k}' THEN {v}" for k, v in tests.items())
    span = "kind || ':' || s || ':' || (s + len(f))"
    around = f"substr(x, greatest(s - {WINDOW}, 0) + 1, s + len(f) + {WINDOW} - greatest(s - {WINDOW}, 0))"
    tenths = "CASE kind " + " ".join(f"WHEN '{k}' THEN {round(10 * a)} + CASE WHEN regexp_matches({around}, '{CONTEXT[k]}') THEN {round(10 * b)} ELSE 0 END" for k, (a, b) in SCORES.items()) + " END"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}') AS BIGINT) AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
m AS ({found}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
p AS (SELECT r, x, kind, rank, m[i] AS f, CAST(list_sum(list_transform(g[1:i], lambda z: len(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: len(z))), 0) AS BIGINT) AS s FROM e),
k AS (SELECT *, {tenths} AS tenths FROM p WHERE CASE kind {valid} END)
SELECT doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(BASE_KINDS)}), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY s, rank), '') AS spans, coalesce(string_agg(CAST(tenths AS VARCHAR), ',' ORDER BY s, rank), '') AS scores
FROM t LEFT JOIN k ON k.r = t.r GROUP BY t.r, doc_id"""
