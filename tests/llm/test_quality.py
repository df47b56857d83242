"""Probabilities and decisions against a plain modified Kneser-Ney model, and what defined cases give."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from quirelake.llm import quality, stages

SF = "/root/testdata/sf0.01"


def plain_model(texts):
    """Probability of a tuple of symbols given those before its last, by dictionaries."""
    counts = {quality.ORDER: Counter()}
    for t in texts:
        line = [0] * (quality.ORDER - 1) + [b + 1 for b in (t or "").encode()]
        for i in range(quality.ORDER - 1, len(line)):
            counts[quality.ORDER][tuple(line[i - quality.ORDER + 1 : i + 1])] += 1
    for order in range(quality.ORDER - 1, 0, -1):
        counts[order] = Counter(k[1:] for k in counts[order + 1])

    cut = {o: quality.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for o, c in counts.items()}
    sums = {o: defaultdict(lambda: [0, 0.0]) for o in counts}
    for o, c in counts.items():
        for k, n in c.items():
            sums[o][k[:-1]][0] += n
            sums[o][k[:-1]][1] += cut[o][min(n, 3) - 1]

    def p(key):
        o = len(key)
        if o == 0:
            return 1 / 256
        total, kept = sums[o][key[:-1]]
        if not total:
            return p(key[1:])
        n = counts[o][key]
        return (n - cut[o][min(n, 3) - 1] if n else 0) / total + kept / total * p(key[1:])

    return p


def plain_loss(p, text):
    line = [0] * (quality.ORDER - 1) + [b + 1 for b in (text or "").encode()]
    return -sum(math.log(p(tuple(line[i - quality.ORDER + 1 : i + 1]))) for i in range(quality.ORDER - 1, len(line)))


def plain_judge(rows, trusted):
    """{id: (perplexity, threshold, keep)} for rows (id, text, lang), with ids that are unique."""
    size = lambda t: len((t or "").encode())
    fold = {k: int(hashlib.md5((t or "").encode()).hexdigest()[:6], 16) % quality.FOLDS for k, t, _ in rows}
    mine = [r for r in rows if r[0] in trusted]
    everything = plain_model([t for _, t, _ in mine])
    held = []
    for k in range(quality.FOLDS):
        others = [t for i, t, _ in mine if fold[i] != k]
        p = plain_model(others) if any(others) else everything
        held += [(lang, plain_loss(p, t), size(t)) for i, t, lang in mine if fold[i] == k]
    mean = sum(x for _, x, _ in held) / sum(n for _, _, n in held)
    rate = lambda x, n: math.exp((x + quality.PRIOR * mean) / (n + quality.PRIOR))
    at = lambda values: sorted(values)[math.ceil(quality.QUANTILE * len(values)) - 1]
    every = at([rate(x, n) for _, x, n in held])
    limits = {}
    for lang in {x[0] for x in held}:
        own = [rate(x, n) for g, x, n in held if g == lang]
        limits[lang] = every + len(own) / (len(own) + quality.SMOOTHING) * (at(own) - every)
    out = {}
    for k, t, lang in rows:
        ppl, limit = rate(plain_loss(everything, t), size(t)), limits.get(lang, every)
        out[k] = ppl, limit, not size(t) or ppl <= limit
    return out


def edges_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("part", [3, 7, 1 << 20])
def test_ngrams_do_not_cross_texts_and_parts_make_up_the_whole(part, monkeypatch):
    monkeypatch.setattr(quality, "_PART", part)
    texts = ["ab", "", "c", "", "abc", "été " * 9, ""]
    want = sum((quality.ngrams(*edges_of([t])).tolist() for t in texts), [])
    assert quality.ngrams(*edges_of(texts)).tolist() == want
    assert sum((grams.tolist() for _, grams, _ in quality._parts(*edges_of(texts))), []) == want
    keys = np.unique(want)
    each = quality.losses(*edges_of(texts), keys, -np.arange(1.0, len(keys) + 1))
    assert np.allclose(each, [sum(1.0 + np.searchsorted(keys, quality.ngrams(*edges_of([t])))) for t in texts])


@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(1)
    words = ["the", "stone", "river", "under", "green", "light", "walks", "slowly", "over", "and"]
    clean = [(i, " ".join(draw.choice(words, draw.integers(5, 200))) + ".", "en") for i in range(120)]
    clean += [(200 + i, " ".join(draw.choice(["ñandú", "río", "verde", "luz"], draw.integers(5, 200))), "es") for i in range(60)]
    clean += [(300, "verde luz", ""), (301, "the green stone", None), (302, "", "en"), (303, clean[3][1], "en")]
    junk = [(500 + i, "%%$$ ## || ZZQX " * (i + 2), "en") for i in range(20)]
    odd = [(900, None, "en"), (901, "", None), (902, "the river", None), (903, "x", "xx"), (904, "\U0001f600\x00 the", ""), (905, "the river " * 400_000, "en"), (2**53 + 1, "the river", "de")]
    labels = [(k, 1, 0) for k, _, _ in clean] + [(k, 0, 0) for k, _, _ in junk[:5]] + [(None, 1, 0), (7777, 1, 0), (510, 1, 1), (511, 1, 0), (511, 0, 0)]
    return clean + junk + odd, labels, {k for k, _, _ in clean}


def frames(spark, corpus):
    rows, labels, trusted = corpus
    docs = spark.createDataFrame([(*r, 7) for r in rows] + [(None, "green light over the river", "en", 7), (1, rows[1][1], "en", 7)], "doc_id long, text string, lang string, fold int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("broadcast_rows,chunk_bytes,shard_records", [(1000, 1 << 30, 500_000), (0, 2000, 50)])
def test_against_a_plain_model(spark, corpus, broadcast_rows, chunk_bytes, shard_records):
    rows, _, trusted = corpus
    docs, labels = frames(spark, corpus)
    judged = quality.judge(quality.with_trust(docs.repartition(3), labels, broadcast_rows=broadcast_rows), chunk_bytes=chunk_bytes, shard_records=shard_records)
    assert judged.columns == ["doc_id", "text", "lang", "fold", "trusted", "perplexity", "threshold", "keep"]
    got = judged.collect()
    assert len(got) == len(rows) + 2 and all(r.fold == 7 for r in got)
    short = [r for r in rows if r[0] != 905]
    want = plain_judge([*short, (-1, rows[1][1], "en")], trusted | {-1})  # the repeated row is trusted too
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        assert r.trusted == (r.doc_id in trusted)
    for k, _, _ in short:
        for r in by_id[k]:
            assert math.isclose(r.perplexity, want[k][0], rel_tol=1e-9) and math.isclose(r.threshold, want[k][1], rel_tol=1e-9) and r.keep == want[k][2], r
    assert len(by_id[1]) == 2 and by_id[1][0][4:] == by_id[1][1][4:]
    kept = {r.doc_id for r in got if r.keep}
    assert len(trusted - kept) <= 1 and {900, 901, 902, 905, None} <= kept and not {k for k in kept if k and 500 <= k < 520}
    limits = {r.lang: r.threshold for r in got}
    assert limits[None] != limits[""] != limits["es"] and limits["xx"] == limits["de"]


def test_one_trusted_text(spark):
    docs = spark.createDataFrame([(1, "a fine text", "en"), (2, "@@##", "en"), (3, "a fine text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(quality.with_trust(docs, labels)).collect()}
    want = plain_judge([(1, "a fine text", "en"), (2, "@@##", "en"), (3, "a fine text", "en")], {1})
    assert all(math.isclose(got[k].perplexity, want[k][0]) and math.isclose(got[k].threshold, want[k][1]) for k in got) and got[1].keep and not got[2].keep


def test_without_trusted_text_empty_and_clashes(spark, corpus):
    docs, labels = frames(spark, corpus)
    got = quality.judge(quality.with_trust(docs, labels.limit(0))).collect()
    assert len(got) == docs.count() and all(r.keep and r.threshold is None and r.perplexity is None for r in got)
    assert quality.judge(quality.with_trust(docs.limit(0), labels)).count() == 0
    named = docs.limit(30).withColumnsRenamed({"fold": "Keep"}).selectExpr("*", "1 AS perplexity", "'t' AS trusted", "2 AS threshold", "3 AS labelled", "4 AS loss", "5 AS size", "6 AS mark", "7 AS language")
    with pytest.raises(ValueError):
        quality.judge(named, "trusted")
    out = stages.keep_good(named, labels)
    want = {r.doc_id for r in quality.judge(quality.with_trust(named.select("doc_id", "text", "lang"), labels)).where("keep").collect()}
    assert out.columns == named.columns and len(want) > 20
    assert sorted(out.collect(), key=str) == sorted((r for r in named.collect() if r.doc_id in want), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    kept = {r.doc_id for r in quality.judge(quality.with_trust(docs, labels)).where("keep").collect()}
    good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert good <= kept
    assert len(junk - kept) >= 0.9 * len(junk)


def test_answers_of_folds_go_before_those_of_all_are_written(spark, monkeypatch):
    steps, cut, forget = [], quality.cut, quality.forget

    def noted(df, label="cut", *a):
        out = cut(df, label, *a)
        if label == "answers":
            steps.append(("written", {r.model for r in out.select("model").distinct().collect()}))
            out.is_answers = True
        return out

    monkeypatch.setattr(quality, "cut", noted)
    monkeypatch.setattr(quality, "forget", lambda df: (steps.append(("gone", None)) if getattr(df, "is_answers", False) else None, forget(df)))
    rows = [(i, f"text number {i} with some words", "en", i % 4 > 0) for i in range(40)]
    assert quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, trusted boolean")).count() == 40
    assert steps == [("written", {0, 1}), ("gone", None), ("written", {-1})]


def test_searches_follow_distinct_ngrams_and_not_bytes(monkeypatch):
    draw = np.random.default_rng(2)
    raw, edges = edges_of(["".join(draw.choice(list("abcdé"), n)) for n in (700_000, 0, 3, 300_000)])  # the first is of several parts
    keys, grams = quality._distinct(raw, edges), quality.ngrams(raw, edges)
    assert keys.tolist() == sorted(set(grams.tolist()))
    known, searched, search = quality.asked(keys), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: searched.append(np.size(v)) or search(a, v, *more, **named))
    logs = quality.log_probabilities(keys, known, np.ones((len(known), len(quality._FIELDS)), np.int64), [(0.5, 0.5, 0.5)] * quality.ORDER)
    assert sum(searched) <= 2 * len(known)
    searched.clear()
    each = quality.losses(raw, edges, keys, logs)
    assert sum(searched) < len(raw) // 10
    want = -logs[search(keys, grams)]
    assert np.allclose(each, [want[a:b].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)], rtol=1e-12)


@pytest.mark.parametrize("shards", [1, 7, 300])
def test_keys_are_dealt_to_shards_in_order(shards):
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 5000))
    places, ends = quality._by_shard(keys, shards)
    for shard in range(shards):
        assert np.array_equal(places[ends[shard] : ends[shard + 1]], np.flatnonzero(quality._shard(keys, shards) == shard))
