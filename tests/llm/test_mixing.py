"""Targets and seats against plain versions, and what documents give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import mixing, stages


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Capped sources drop out and the rest is shared anew, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if level[s] > cap * sizes[s]]
        if not over:
            return fixed | level
        fixed |= {s: cap * sizes[s] for s in over}


def test_seats_go_by_highest_quotients():
    draw = np.random.default_rng(0)
    for trial in range(600):
        n, seats = draw.integers(1, 12), int(draw.integers(0, 60))
        votes = [draw.integers(0, 50, n), draw.random(n) * 100, np.full(n, 3.0)][trial % 3]
        want = np.zeros(n, int)
        for _ in range(seats if votes.sum() > 0 else 0):
            want[np.argmax(votes / (2 * want + 1))] += 1
        assert (mixing.sainte_lague(votes, seats) == want).all()
    assert mixing.sainte_lague(np.array([1e12, 3e12]), 10**9).tolist() == [25 * 10**7, 75 * 10**7]


def corpus(seed):
    draw = np.random.default_rng(seed)
    rows = []
    for source, n, words in (("a", 60, 200), ("b", 300, 50), (None, 40, 100), ("é", 5, 3), ("z", 80, 120), ("empty", 3, 0)):
        for _ in range(n):
            rows.append((len(rows), " ".join(f"w{x}" for x in draw.integers(0, 900, draw.integers(0, 2 * words + 1))), source))
    return rows + [(None, "null id \t words\n", "a"), (1, None, "a"), (2, "same same", "b"), (2, "same same", "b"), (3, "x " * 5000, "a")]


@pytest.mark.parametrize("shard_words", [2_000_000, 1500])
def test_mix(spark, shard_words):
    rows = corpus(shard_words)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    mixed = mixing.mix_documents(df, shard_words=shard_words)
    got = mixed.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(sizes.values())
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert sum((s.last - s.first) * s.times for s in r.segments) == r.taken
        by_size.setdefault((r.source_size, round(r.target, 3)), [0])[0] += r.taken
    for s, size in sizes.items():
        taken = by_size[size, round(want[s], 3)][0]
        assert abs(taken - want[s]) <= max(0.05 * want[s], 3), (s, taken, want[s])
    again = mixing.mix_documents(df.repartition(7), shard_words=shard_words).collect()
    key = lambda r: (str(r.doc_id), r.text_hash, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_stage_builds_the_texts(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, 5, i % 3, "z", 0.5) for i, r in enumerate(rows)], "doc_id long, text string, source string, n_chars long, row int, doc string, size double")
    out = stages.mix_sources(df)
    assert out.columns == df.columns
    got = out.collect()
    taken = {}
    for r in mixing.mix_documents(df).collect():
        taken.setdefault(r.doc_id, [0])[0] += r.taken
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert {k: n for k, (n,) in taken.items() if n} == words  # the stage takes what the operator takes
    plain = {}
    for i, (k, t, s) in enumerate(rows):
        plain.setdefault((k, s), []).append((t or "").split())
    for r in got:  # and words in their order
        assert any(is_part(r.text.split(), w) for w in plain[r.doc_id, r.source])
    whole = {t for _, t, _ in rows}
    assert all(r.n_chars == len(r.text) and r.doc == "z" for r in got) and sum(r.text in whole for r in got) > 0.3 * len(got)
    again = stages.mix_sources(df.repartition(5, "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def is_part(some, whole):
    rest = iter(whole)
    return all(w in rest for w in some)


def test_blocks_against_a_plain_choice(spark):
    """One source in one shard: the order, the blocks, and the seeded choice of those that are passed once more."""
    rows = [(i, "w " * (3 + 7 * i % 11), "a") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = df.select("doc_id", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).collect()
    order = [r.doc_id for r in sorted(hashed, key=lambda r: r.h)]
    size = {k: len(t.split()) for k, t, _ in rows}
    total = sum(size.values())
    target = 1.5 * total
    block = max(1, min(mixing.MAX_BLOCK, int(target // mixing.SEATS_AT_LEAST)))
    seats, n = round(target / block), -(-total // block)
    times = [seats // n] * n
    for b in np.random.default_rng([mixing.SEED, 0, *b"0a"]).permutation(n)[: seats % n]:
        times[b] += 1
    want, at = {}, 0
    for k in order:
        want[k] = sum(times[w // block] for w in range(at, at + size[k]))
        at += size[k]
    assert {r.doc_id: r.taken for r in mixing.mix_documents(df).collect()} == want


def test_ids_beside_a_null_one(spark):
    ids = [2**53 + 1, None, 2**53 + 3, 2**63 - 1]
    df = spark.createDataFrame([(i, "one two three", "a") for i in ids], "doc_id long, text string, source string").coalesce(1)
    assert {r.doc_id for r in mixing.mix_documents(df).collect()} == set(ids)


def test_a_text_over_many_blocks(spark):
    df = spark.createDataFrame([(1, "a b " * 300_000, "s"), (2, "c", "t")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_documents(df).collect()}
    assert got[1].size == 600_000 and abs(got[1].taken - got[1].target) <= 600
    out = {r.doc_id: 0 for r in []}
    for r in stages.mix_sources(df).collect():
        out[r.doc_id] = out.get(r.doc_id, 0) + len(r.text.split())
    assert out == {k: r.taken for k, r in got.items() if r.taken}


def test_empty_table(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
