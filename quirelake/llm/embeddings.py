"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

1. Tight groups. Vectors that fall into one bucket of a first hash are put with a leader at most
   ``tight`` degrees away, so copies and near copies shrink to a few leaders. Buckets of more than
   ``salt_rows`` vectors are salted first; leaders of salted buckets are grouped again. Any two
   members of a group are within twice ``tight`` degrees, hence linked.
2. Leaders are hashed in ``tables`` tables or more, by ``heads`` rotations a time, with probes to the next best
   buckets. Rotations grow with the number of vectors, and tables with them, so that two leaders as far apart as
   a link between members of their groups allows meet with probability ``RECALL`` at any size. Each entry carries its leader as 8-bit components; pairs that may hold links at that
   precision are candidates.
3. Candidate pairs are checked in double precision. By the triangle inequality a pair of groups is
   linked as a whole, not at all, or, between the two, compared member by member.

So groups of copies are never expanded into pairs, and a link between different vectors is lost only
if all tables miss its leaders.

Defined results: a vector that is null, empty, zero, or has null or non-finite components links with
nothing; vectors of different lengths are never compared; repeated rows are vectors of their
own; null ids are kept and name a component only if all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.components import connected
from quirelake.session import cut

COSINE = 0.9
TIGHT = 8.0  # degrees
TABLES = 8
PROBES = 3
RECALL = 0.99
BUCKET_ENTRIES = 200
SALT_ROWS = 5000
SEED = 77
LEVELS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / math.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and the transform, on rows padded to a power of two."""
    d = max(16, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), d), np.float64)
    out[:, : x.shape[1]] = x
    draw = np.random.default_rng([seed, d])
    for _ in range(3):
        out = hadamard(out * draw.choice([-1.0, 1.0], d))
    return out


def polytope(x: np.ndarray, seed: int, choices: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``choices`` nearest vertices of the cross-polytope, nearest first, and what each loses."""
    y = rotate(x, seed)
    size = np.abs(y)
    best = np.argsort(-size, axis=1)[:, :choices]
    value = np.take_along_axis(y, best, 1)
    loss = np.abs(value[:, :1]) - np.abs(value)
    return 2 * best + (value < 0), loss


def buckets(x: np.ndarray, table: int, heads: int, probes: int, seed: int) -> np.ndarray:
    """``probes`` bucket numbers for each row, the best first: one vertex for each of ``heads`` rotations, then the cheapest changes of one vertex."""
    d = 2 * max(16, 1 << (x.shape[1] - 1).bit_length())
    found = [polytope(x, seed + 1000 * table + h, probes) for h in range(heads)]
    base = np.zeros(len(x), np.uint64)
    for vertex, _ in found:
        base = base * np.uint64(d) + vertex[:, 0].astype(np.uint64)
    out, costs = [base], [np.zeros(len(x))]
    for h, (vertex, loss) in enumerate(found):
        weight = np.uint64(d ** (heads - 1 - h))
        for c in range(1, probes):
            out.append(base + (vertex[:, c].astype(np.uint64) - vertex[:, 0].astype(np.uint64)) * weight)
            costs.append(loss[:, c])
    order = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(np.stack(out, 1), order, 1)


def _matrix(values) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in values])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(values):
    """Index arrays of vectors of equal length."""
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    for n in np.unique(sizes).tolist():
        yield n, np.flatnonzero(sizes == n)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))


def home_bucket(frame: DataFrame, level: int, heads: int, seed: int) -> DataFrame:
    """Adds bucket: the first hash of each vector, with its length."""

    @F.pandas_udf("long")
    def home(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), np.uint64)
        for n, at in _by_length(values):
            out[at] = buckets(_matrix(values.iloc[at]), 500 + level, heads, 1, seed)[:, 0] * np.uint64(4096) + np.uint64(n % 4096)
        return pd.Series(out.view(np.int64))

    return frame.withColumn("bucket", home("v"))


def _led(members: DataFrame, tight: float) -> DataFrame:
    """cid, leader, angle for each row of a salted bucket: the first row that no leader is near becomes one."""

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", kind="stable").reset_index(drop=True)
        parts = []
        for _, at in _by_length(pdf["v"]):
            x, ids, reach = _matrix(pdf["v"].iloc[at]), pdf["cid"].to_numpy()[at], pdf["reach"].to_numpy()[at]
            leader, angle, free = np.zeros(len(at), np.int64), np.zeros(len(at)), np.arange(len(at))
            while len(free):
                away = _angle(x[free] @ x[free[0]])
                away[0] = 0.0
                near = away + reach[free] <= tight
                near[0] = True
                leader[free[near]], angle[free[near]] = ids[free[0]], away[near]
                free = free[~near]
            parts.append(pd.DataFrame({"cid": ids, "leader": leader, "angle": angle}))
        return pd.concat(parts)

    return members.groupBy("bucket", "salt").applyInPandas(lead, "cid long, leader long, angle double")


def tight_groups(classes: DataFrame, heads: int, tight: float, salt_rows: int, seed: int) -> DataFrame:
    """cid, leader, angle: a partition of the classes (cid, v) into groups around leaders."""
    out, frame = None, classes.select("cid", "v", F.lit(0.0).alias("reach"))
    for level in range(LEVELS):
        placed = cut(home_bucket(frame, level, heads, seed), "home-buckets")
        counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        hot = cut(counts.where(F.col("n") > salt_rows), "hot-buckets")
        placed = placed.join(hot, "bucket", "left")
        salts = F.ceil(F.coalesce("n", F.lit(1)) / salt_rows)
        led = cut(_led(placed.withColumn("salt", F.pmod(F.xxhash64("cid"), salts)), tight), "leaders")
        if out is None:
            out = led
        else:  # members follow their leaders; angles add up
            up = led.select(F.col("cid").alias("leader"), F.col("leader").alias("top"), F.col("angle").alias("more"))
            out = cut(out.join(up, "leader").select("cid", F.col("top").alias("leader"), (F.col("angle") + F.col("more")).alias("angle")), "leaders")
        if hot.isEmpty():
            break
        reach = out.groupBy("leader").agg(F.max("angle").alias("reach"))
        frame = classes.join(reach, classes.cid == reach.leader).select("cid", "v", "reach")
    return out


def candidates(leaders: DataFrame, n: int, cosine: float, tables: int, heads: int, probes: int, seed: int) -> DataFrame:
    """a < b: pairs of leaders (cid, v, reach) that share a bucket and may hold a link."""
    limit, slots = math.degrees(math.acos(cosine)), max(int(leaders.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tables * probes // 300_000 + 1)

    def spread(batches):
        for batch in batches:
            for dim, at in _by_length(batch["v"]):
                x = _matrix(batch["v"].iloc[at])
                small = np.round(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)
                ids, reach = batch["cid"].to_numpy()[at], batch["reach"].to_numpy()[at].astype(np.float32)
                for t in range(tables):
                    found = buckets(x, t, heads, probes, seed)
                    key = (found * np.uint64(tables) + np.uint64(t)).ravel()
                    who = np.repeat(np.arange(len(at)), probes)
                    slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % slots
                    order = np.argsort(slot, kind="stable")
                    edges = np.searchsorted(slot[order], np.arange(slots + 1))
                    used = np.flatnonzero(np.diff(edges))
                    take = [order[edges[s] : edges[s + 1]] for s in used.tolist()]
                    yield pd.DataFrame({
                        "slot": used, "dim": dim, "keys": [key[i].tobytes() for i in take], "ids": [ids[who[i]].tobytes() for i in take],
                        "reach": [reach[who[i]].tobytes() for i in take], "small": [small[who[i]].tobytes() for i in take],
                    })

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for dim, part in pdf.groupby("dim"):
            key, ids = (np.concatenate([np.frombuffer(r, k) for r in part[c]]) for c, k in (("keys", np.uint64), ("ids", np.int64)))
            reach = np.concatenate([np.frombuffer(r, np.float32) for r in part["reach"]])
            x = np.concatenate([np.frombuffer(r, np.int8).reshape(-1, dim) for r in part["small"]]).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            # one component is off by 1/254 of the largest at most
            slack = float(2 * np.degrees(np.arcsin(min(1.0, math.sqrt(dim) / 254 * np.abs(x).max()))))
            order = np.argsort(key, kind="stable")
            key, ids, reach, x = key[order], ids[order], reach[order], x[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
                for lo in range(i, j, 2000):
                    hi = min(lo + 2000, j)
                    near = _angle(x[lo:hi] @ x[i:j].T) <= limit + slack + reach[lo:hi, None] + reach[None, i:j]
                    r, c = np.nonzero(near)
                    keep = ids[lo + r] < ids[i + c]
                    a.append(ids[lo + r][keep])
                    b.append(ids[i + c][keep])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    sent = leaders.mapInPandas(spread, "slot long, dim int, keys binary, ids binary, reach binary, small binary")
    return sent.groupBy("slot").applyInPandas(meet, "a long, b long").distinct()


def _cosines(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds cosine, in double precision."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a))
        for n, at in _by_length(a):
            x, y = (np.stack([np.asarray(v, np.float64) for v in s.iloc[at]]) for s in (a, b))
            out[at] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        return pd.Series(out)

    return pairs.withColumn("cosine", cosine(left, right))


def heads_for(n: int, dim: int, tables: int, probes: int, entries: int = BUCKET_ENTRIES) -> int:
    """Rotations a table needs so that a bucket holds about ``entries`` of n vectors."""
    return max(1, math.ceil(math.log(max(n * probes / entries, 1.0)) / math.log(2 * max(16, 1 << (max(dim, 1) - 1).bit_length()))))


def tables_for(heads: int, dim: int, angle: float, probes: int, least: int = TABLES, recall: float = RECALL) -> int:
    """Tables, ``least`` or more, so that vectors ``angle`` degrees apart share a bucket with probability ``recall``.

    The share of pairs that meet in one table is measured on drawn pairs, less two standard errors.
    """
    draw = np.random.default_rng([SEED, heads, dim])
    x = draw.normal(size=(1000, max(dim, 2)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = math.cos(math.radians(angle)) * x + math.sin(math.radians(angle)) * y
    met = n = 0
    while n < 16_000 or (met < 200 and n < 200_000):
        a, b = (buckets(z, n // 1000, heads, probes, SEED + 1) for z in (x, y))
        met, n = met + int((a[:, :, None] == b[:, None, :]).any((1, 2)).sum()), n + 1000
    share = met / n
    share = max(share - 2 * math.sqrt(share * (1 - share) / n), 1e-6)
    return max(least, math.ceil(math.log(1 - recall) / math.log1p(-min(share, 0.999))))


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, tables: int = TABLES,
    probes: int = PROBES, tight: float = TIGHT, salt_rows: int = SALT_ROWS, seed: int = SEED,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    if 2 * tight > math.degrees(math.acos(cosine)):
        raise ValueError("tight groups must lie within the linking angle")
    v = F.col(vec_col).cast("array<double>")
    usable = F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select(F.col(id_col).alias("k"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    rows = cut(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    good = rows.where(F.col("v").isNotNull())
    classes = good.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    heads = heads_for(size.n, size.d or 1, tables, probes)
    members = cut(tight_groups(classes, heads, tight, salt_rows, seed), "groups")
    sized = members.join(classes.select("cid", "n", "least"), "cid")
    groups = sized.groupBy("leader").agg(F.max("angle").alias("reach"), F.sum("n").alias("n"), F.min("least").alias("least"))
    groups = cut(groups.join(classes.select(F.col("cid").alias("leader"), "v"), "leader").withColumnRenamed("leader", "cid"), "group-leaders")
    widest = math.degrees(math.acos(cosine)) + 2 * (groups.agg(F.max("reach")).first()[0] or 0.0)
    tables = tables_for(heads, size.d or 1, widest, probes, tables)
    pairs = candidates(groups.select("cid", "v", "reach"), size.n, cosine, tables, heads, probes, seed)
    side = lambda p: groups.select(F.col("cid").alias(p), F.col("v").alias(f"v{p}"), F.col("reach").alias(f"r{p}"), F.col("n").alias(f"n{p}"))
    limit = math.degrees(math.acos(cosine))
    judged = _cosines(pairs.join(side("a"), "a").join(side("b"), "b"), "va", "vb")
    away, both = F.degrees(F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0)))), F.col("ra") + F.col("rb")
    single = both == 0  # two leaders alone: the cosine itself decides
    state = (
        F.when(single, F.when(F.col("cosine") >= cosine, "all").otherwise("none"))
        .when(away + both <= limit - 1e-6, "all").when(away - both > limit + 1e-6, "none").otherwise("some")
    )
    judged = cut(judged.select("a", "b", "na", "nb", state.alias("state")).where(F.col("state") != "none"), "group-pairs")
    whole = judged.where(F.col("state") == "all")
    by_group = whole.select(F.col("a").alias("leader"), F.col("nb").alias("m")).unionByName(whole.select(F.col("b").alias("leader"), F.col("na").alias("m")))
    by_group = by_group.groupBy("leader").agg(F.sum("m").alias("group_links"))
    some = judged.where(F.col("state") == "some")
    of = lambda p: members.join(classes.select("cid", "n", "v"), "cid").select(F.col("leader").alias(p), F.col("cid").alias(f"c{p}"), F.col("n").alias(f"m{p}"), F.col("v").alias(f"v{p}"))
    met = _cosines(some.select("a", "b").join(of("a"), "a").join(of("b"), "b"), "va", "vb").where(F.col("cosine") >= cosine)
    met = cut(met.select("a", "b", "ca", "cb", "ma", "mb"), "member-links")
    by_member = met.select(F.col("ca").alias("cid"), F.col("mb").alias("m")).unionByName(met.select(F.col("cb").alias("cid"), F.col("ma").alias("m")))
    by_member = by_member.groupBy("cid").agg(F.sum("m").alias("member_links"))
    roots = connected(whole.select("a", "b").unionByName(met.select("a", "b").distinct()))
    named = groups.select(F.col("cid").alias("leader"), "n", "least").join(roots, F.col("leader") == roots.node, "left")
    named = named.withColumn("root", F.coalesce("root", "leader"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(tops, "root").join(by_group, "leader", "left").select("leader", F.col("n").alias("group_n"), "component_id", "group_links")
    by_class = members.select("cid", "leader").join(named, "leader").join(by_member, "cid", "left").join(classes.select("cid", "h1", "h2"), "cid")
    links = F.col("group_n") - 1 + F.coalesce("group_links", F.lit(0)) + F.coalesce("member_links", F.lit(0))
    by_class = by_class.select("h1", "h2", links.cast("long").alias("n_links"), "component_id")
    found = good.select("k", "h1", "h2").join(by_class, ["h1", "h2"]).select("k", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("k").alias(id_col), "n_links", F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("k") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, CAST(component_id AS BIGINT) AS component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id"""
