"""Hosts, paths, rules and vocabulary against plain readings."""

import re

from quirelake.llm import urls

CASES = [
    None, "", "no scheme/en/", "http://", "https://Example.COM/en/7abc?x#y", "http://a.example.com/en/8", "http://com/en/", "http://xcom/en/1",
    "http://example.com:80/en/1", "http://u@b.net/de/5", "ftp://example.net/de/8", "http://example.net/de/81", "http://notexample.net/de/8", "http://x.org/es/", "http://x.org/es",
    "http://x.org?/es/", "http://x.org#://y.com/en/", "a://b://c.com/en/", "http://x.com/EN/", "://x.com/en/q", "http://ÄB.com/en/1\n2", "http://casino.info/", "http://mycasino.info/", "http://CASINO-x.info",
    "http://free-bets.info/", "http://free.info/free", "http://free.info/win_win", "http://sussex.info/sex", "http://x.net/de/casino", "http://éfree-win.info", "http://x.info/1free/win",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.prefix), default=None)
    low = (url or "").lower()
    has = lambda t: re.search(rf"(?<![a-zA-Z0-9]){t}(?![a-zA-Z0-9])", low) is not None
    strict, soft = sum(map(has, urls.STRICT)), [t for t in urls.SOFT if has(t)]
    weight = sum(urls.SOFT[t] for t in soft)
    verdict = best.verdict if best else "block" if strict or (len(soft) >= 2 and weight >= 2) else "allow"
    return host, path, best.prefix if best else None, verdict, strict, len(soft), weight


def test_against_plain_reading(spark):
    rows = [(i, u, "<p>") for i, u in enumerate(CASES)] + [(None, CASES[4], None), (4, CASES[4], "host")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(CASES[r.page_id if r.page_id is not None else 4])
        assert tuple(r)[1:] == want, CASES[r.page_id or 4]


def test_weights(spark):
    rows = [("http://a.b/adult", "allow"), ("http://a.b/adult-hot", "block"), ("http://a.b/adult/adult/adult", "allow"), ("http://a.b/hot-sale-deal", "allow"), ("http://a.b/hot-sale-deal-vip", "block"), ("http://a.b/hotel", "allow")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    assert [r.verdict for r in urls.judge_urls(df).orderBy("page_id").collect()] == [v for _, v in rows]


def test_very_long_and_empty(spark):
    long = "http://x.info/" + "a" * 200_000 + "/casino"
    assert urls.judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string")).first().verdict == "block"
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
