"""Links, counts and components against all pairs."""

import numpy as np
import pytest

from quirelake.llm import embeddings


def plain(rows, cosine=0.9):
    ids = [k for k, _ in rows]
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.asarray(rows[k][1], np.float64) for k in (i, j))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[i].append(j)
                    links[j].append(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            part, stack = {i}, [i]
            while stack:
                for j in links[stack.pop()]:
                    if j not in part:
                        part.add(j)
                        stack.append(j)
            seen |= part
            least = min((ids[j] for j in part if ids[j] is not None), default=None)
            for j in part:
                out[j] = (ids[j], len(links[j]), least, ids[j] == least and least is not None)
    return sorted(out, key=str)


def vectors(seed, n=120, d=24):
    draw = np.random.default_rng(seed)
    rows, base = [], draw.normal(size=(12, d))
    for i in range(n):
        noise = draw.choice([0.0, 0.02, 0.08, 0.2, 0.35])
        rows.append((i, (base[draw.integers(0, 12)] + noise * draw.normal(size=d)).tolist()))
    rows += [(200 + i, rows[5][1]) for i in range(40)] + [(300, [2 * x for x in rows[5][1]]), (301, [-x for x in rows[5][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * d), (403, [float("nan")] * d), (404, [None] + [1.0] * (d - 1)), (405, [float("inf")] * d), (406, [1.0]), (407, [2.0]), (408, [-0.0, 1.0]), (409, [0.0, 1.0])]
    return rows + [(None, rows[7][1]), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("salt_rows", [5000, 20])
def test_against_all_pairs(spark, salt_rows):
    rows = vectors(salt_rows)
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, label int")
    plainly = [(k, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for k, v in rows]
    got = sorted([tuple(r) for r in embeddings.near_duplicates(df, salt_rows=salt_rows).collect()], key=str)
    assert got == plain(plainly)


def test_recall_of_the_index():
    """Pairs at a cosine just above the limit share a bucket; the share is the recall to expect without groups."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * y
    for heads in (1, 2):
        hit = np.zeros(len(x), bool)
        for t in range(embeddings.TABLES):
            a, b = (embeddings.buckets(z, t, heads, embeddings.PROBES, embeddings.SEED) for z in (x, y))
            hit |= (a[:, :, None] == b[:, None, :]).any((1, 2))
        assert hit.mean() > 0.99


@pytest.mark.parametrize("heads, dim", [(2, 64), (3, 64), (4, 64), (2, 128), (3, 128)])
@pytest.mark.parametrize("groups", [0.0, 2 * embeddings.TIGHT])
def test_recall_at_more_rotations(heads, dim, groups):
    """Leaders of linked vectors, at the edges of their groups too, share a bucket."""
    draw = np.random.default_rng(heads)
    angle = np.degrees(np.arccos(0.9)) + groups
    x = draw.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = np.cos(np.radians(angle)) * x + np.sin(np.radians(angle)) * y
    hit = np.zeros(len(x), bool)
    for t in range(embeddings.tables_for(heads, dim, angle, embeddings.PROBES)):
        a, b = (embeddings.buckets(z, t, heads, embeddings.PROBES, embeddings.SEED) for z in (x, y))
        hit |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert hit.mean() > 0.97


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(embeddings.hadamard(embeddings.hadamard(x)), x)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
