"""URL filter: host and path rules first, then a weighted URL vocabulary.

The vocabulary is searched with one Aho-Corasick automaton per Python worker. A hit counts only
where the characters beside it are not ASCII letters or digits. One strict hit rejects; so do
several distinct soft hits whose weights add up to ``soft_needed``, each term counted once.

Defined results: a null url or one without ``://`` has host and path ``''``, fits no rule and is
judged by the vocabulary (null: allow). Repeated rows each get a verdict. Columns of the input
other than the id and the url are not read, so their names don't matter. A very long url is searched as a whole, in one pass.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``prefix`` is ``host/path...``: it fits the host, its subdomains, and paths with that start."""

    verdict: str
    prefix: str

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.partition("/")[2]


# The rules of the query.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)

# The vocabulary. A strict term alone rejects; soft terms reject together, by weight.
STRICT = (
    "bookmaker", "bukkake", "camgirl", "camgirls", "cialis", "casino", "casinos", "cumshot", "escort", "escorts", "gambling", "hentai", "keygen", "malware", "milf", "phishing", "poker", "porn",
    "porno", "pornhub", "roulette", "sportsbook", "tramadol", "viagra", "warez", "xnxx", "xvideos", "xxx",
)
SOFT_WEIGHTS = {
    1.5: ("adult", "bet", "bets", "betting", "crack", "cracked", "erotic", "fetish", "jackpot", "nude", "nudes", "payday", "pills", "serial", "sex", "slots", "torrent"),
    1.0: ("babes", "bonus", "dating", "detox", "forex", "free", "girls", "hookup", "loan", "loans", "lottery", "lotto", "naked", "pharmacy", "replica", "rolex", "sexy", "singles", "spin", "weightloss", "win", "winner"),
    0.5: ("18", "amateur", "bonuses", "cash", "cheap", "coupon", "credit", "deal", "deals", "discount", "earn", "hot", "live", "meds", "money", "offer", "prize", "promo", "rich", "sale", "teen", "vip", "webcam"),
}
SOFT = {term: weight for weight, terms in SOFT_WEIGHTS.items() for term in terms}

_AUTOMATA: dict[tuple, object] = {}


def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]):
    key = (strict, soft)
    if key not in _AUTOMATA:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in soft:
            found.add_word(term, (term, weight, False))
        for term in strict:
            found.add_word(term, (term, 0.0, True))
        found.make_automaton()
        _AUTOMATA[key] = found
    return _AUTOMATA[key]


def count_terms(url: str, automaton) -> tuple[int, int, float]:
    """Distinct strict terms, distinct soft terms and the soft terms' weight in one url."""
    low = url.lower()
    strict, soft, weight = set(), set(), 0.0
    for end, (term, w, is_strict) in automaton.iter(low):
        start = end - len(term) + 1
        before, after = low[start - 1 : start] if start else "", low[end + 1 : end + 2]
        if (before.isascii() and before.isalnum()) or (after.isascii() and after.isalnum()):
            continue
        if is_strict:
            strict.add(term)
        elif term not in soft:
            soft.add(term)
            weight += w
    return len(strict), len(soft), weight


def vocabulary_hits(url: Column, strict=STRICT, soft=SOFT) -> Column:
    """Column struct<strict int, soft int, weight double>."""
    strict_key, soft_key = tuple(strict), tuple(sorted(soft.items()))

    @F.pandas_udf("strict int, soft int, weight double")
    def hits(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(strict_key, soft_key)
        rows = [count_terms(u, automaton) if isinstance(u, str) else (0, 0, 0.0) for u in urls]
        return pd.DataFrame(rows, columns=["strict", "soft", "weight"])

    return hits(url)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
    soft_needed: float = 2.0,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    The longest fitting rule decides; without one the vocabulary does. No shuffle.
    """
    base = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    base = base.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):  # later, longer rules win
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, said = F.when(fits, F.lit(r.prefix)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(said)
    out = base.withColumn("rule", rule).withColumn("_said", said)
    out = out.withColumn("_hits", vocabulary_hits(F.col("_url"), strict, soft))
    rejected = (F.col("_hits.strict") >= 1) | ((F.col("_hits.soft") >= 2) & (F.col("_hits.weight") >= soft_needed))
    return out.select(
        id_col, "host", "path", "rule",
        F.coalesce("_said", F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        F.col("_hits.strict").alias("strict_hits"), F.col("_hits.soft").alias("soft_hits"), F.col("_hits.weight").alias("soft_weight"),
    )


def oracle(strict=STRICT, soft=SOFT, rules=RULES, soft_needed: float = 2.0) -> str:
    """The same in DuckDB SQL."""
    has = lambda t: f"CAST(regexp_matches(lower(coalesce(url,'')), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
    ordered = sorted(rules, key=lambda r: (-len(r.prefix), r.prefix))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    return f"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN url IS NULL OR NOT contains(url, '://') THEN ''
         ELSE translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR NOT contains(url, '://') THEN ''
         ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
h AS (
  SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r.prefix}'" for r in ordered)} END AS rule,
    CASE {" ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)} END AS said,
    {" + ".join(map(has, strict))} AS strict_hits, {" + ".join(map(has, soft))} AS soft_hits, CAST({" + ".join(f"{w} * {has(t)}" for t, w in soft.items())} AS DOUBLE) AS soft_weight
  FROM p)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN strict_hits >= 1 OR (soft_hits >= 2 AND soft_weight >= {soft_needed}) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_hits AS INT) AS strict_hits, CAST(soft_hits AS INT) AS soft_hits, soft_weight
FROM h"""
