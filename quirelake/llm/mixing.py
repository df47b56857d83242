"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target in words: weights share a total, no target passes ``cap`` times its
source's size, and what is cut off is shared again by weight. The targets are votes for seats;
a seat is one pass over a block of ``block`` words. Seats go to sources, then to the shards of
each source, by highest quotients. In a shard, the documents in seeded order form one stream of
words that is cut into equal blocks; each block is passed floor(seats / blocks) times and a seeded
choice of blocks once more.

A shard has about ``shard_words`` words and ``shard_rows`` documents, so a source of any size is spread
over many tasks; only id, source, size and a hash are shuffled. Per-source tables are one row per
source, shard tables one row per shard.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; sources of size 0 have target 0; repeated rows are documents of their own; an empty table
gives no rows; a text of any length is counted as a whole and may span many blocks; other columns aren't read, so
their names don't matter. Reruns agree: the seeded order follows id and text, then the columns ``ties``; rows that
are equal in all of these are alike. Ids travel as text, since a null among longs would make them floating point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 20240229
SHARD_WORDS = 2_000_000
SHARD_ROWS = 100_000
MAX_BLOCK = 256
SEATS_AT_LEAST = 256


def word_count(text):
    """Number of maximal runs of characters other than U+0020 and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier entry, without listing
    the quotients: a divisor is searched that gives at most ``seats``; what is left goes to ties."""
    votes = np.maximum(np.asarray(votes, dtype=np.float64), 0.0)
    out = np.zeros(len(votes), np.int64)
    if seats <= 0 or not votes.sum() > 0:
        return out
    given = lambda d: np.floor(votes / d + 0.5)
    low, high = votes.sum() / (seats + len(votes) + 1.0), 2.0 * votes.sum() / seats + votes.max() * 3
    for _ in range(200):  # low gives at least the seats, high at most
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle).sum() > seats else (low, middle)
        if given(high).sum() == seats or high - low <= 1e-12 * high:
            break
    out = given(high).astype(np.int64)
    left = seats - int(out.sum())  # those that are left have quotients equal to the divisor: ties
    best = np.argsort(-(votes / (2.0 * out + 1.0)), kind="stable")[:left]
    out[best] += 1
    return out


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target: one row per source.

    Sorted by how soon they reach their cap, the capped sources come first; the level of all the
    others follows from prefix sums.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sums.withColumn("rank", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    by_level = everything.orderBy(F.col("fills"), F.col("rank"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("fills", cap * F.col("source_size") / F.col("weight"))
    rows = rows.withColumn("total", share * F.sum("source_size").over(everything))
    rest = F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))
    free = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", rest / free)
    level = F.min(F.when(F.col("fills") >= F.col("level"), F.struct("fills", "rank", "level"))).over(everything)["level"]
    rows = rows.withColumn("target", F.least(cap * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return rows.select("source", "source_size", "n_docs", "target")


def _apportion_shards(shards: DataFrame) -> DataFrame:
    """Seats of the shards of one source, by the shards' words."""

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard", kind="stable").reset_index(drop=True)
        pdf["seats"] = sainte_lague(pdf["shard_words"].to_numpy(), int(pdf["source_seats"].iloc[0]))
        return pdf[["source_key", "shard", "seats"]]

    return shards.groupBy("source_key").applyInPandas(share_out, "source_key string, shard long, seats long")


def _apportion_sources(targets: DataFrame, max_block: int, seats_at_least: int) -> DataFrame:
    """Adds block (words of a seat) and source_seats; the smallest target gets ``seats_at_least`` seats or blocks of one word."""

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source_key", kind="stable").reset_index(drop=True)
        wanted = pdf["target"].to_numpy()
        least = wanted[wanted > 0].min() if (wanted > 0).any() else 1.0
        block = int(max(1, min(max_block, least // seats_at_least)))
        pdf["block"] = block
        pdf["source_seats"] = sainte_lague(wanted, int(round(wanted.sum() / block)))
        return pdf[["source_key", "block", "source_seats"]]

    return targets.groupBy().applyInPandas(share_out, "source_key string, block long, source_seats long")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    share: float = SHARE, cap: float = CAP, seed: int = SEED, shard_words: int = SHARD_WORDS,
    shard_rows: int = SHARD_ROWS, max_block: int = MAX_BLOCK, seats_at_least: int = SEATS_AT_LEAST, row_col: str | None = None, ties: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, text_hash, size, source_size, target, taken and its segments; with ``row_col`` (a long without
    nulls) instead of the id.

    ``segments`` is array<struct<first long, last long, times int>>: words [first, last) of the document
    are taken ``times`` times, parts taken 0 times are left out.
    """
    id_type = "bigint" if row_col else docs.schema[id_col].dataType.simpleString()
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    own, text_hash, tie = F.col(id_col), F.xxhash64(text_col), F.xxhash64(F.lit(1), *ties)
    sized = docs.select(
        F.col(row_col or id_col).cast("string").alias("k"), F.col(source_col).cast("string").alias("source"), text_hash.alias("th"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), own, text_hash).alias("h"), F.coalesce(own.cast("string"), F.lit("")).alias("named"), tie.alias("tie"),
    )
    sized = cut(sized.withColumn("source_key", key), "mix-sizes")
    targets = source_targets(sized, weights, share, cap).withColumn("source_key", key)
    targets = cut(targets.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / shard_rows)).cast("long")), "mix-targets")
    seats = cut(_apportion_sources(targets, max_block, seats_at_least), "mix-seats")
    known = cut(targets.join(seats, "source_key").select("source_key", "source_size", "target", "n_shards", "block", "source_seats"), "mix-sources")
    placed = sized.join(known, "source_key").withColumn("shard", F.pmod("h", "n_shards"))
    words = placed.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_words"), F.first("source_seats").alias("source_seats"))
    shards = cut(_apportion_shards(words), "mix-shards")

    def choose(keys, pdf: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["k", "th", "size", "source_size", "target", "taken", "segments"])
        name, shard = keys
        pdf = pdf.sort_values(["h", "named", "th", "tie"], kind="stable").reset_index(drop=True)
        size, block = pdf["size"].to_numpy(np.int64), int(pdf["block"].iloc[0])
        ends = np.cumsum(size)
        total = int(ends[-1])
        n_blocks = -(-total // block)
        wanted = min(int(quota["seats"].iloc[0]) if len(quota) else 0, int(cap) * n_blocks)
        times = np.full(n_blocks, wanted // n_blocks if n_blocks else 0, np.int64)
        draw = np.random.default_rng([seed, int(shard), *name.encode("utf-8", "surrogatepass")])
        if n_blocks:
            times[draw.permutation(n_blocks)[: wanted % n_blocks]] += 1
        edges = np.minimum(np.arange(n_blocks + 1, dtype=np.int64) * block, total)
        taken, parts = np.zeros(len(pdf), np.int64), []
        for i, (last, n) in enumerate(zip(ends.tolist(), size.tolist(), strict=True)):
            first, found = last - n, []
            if n:
                for b in range(first // block, (last - 1) // block + 1):
                    lo, hi, t = max(first, int(edges[b])) - first, min(last, int(edges[b + 1])) - first, int(times[b])
                    taken[i] += t * (hi - lo)
                    if t and found and found[-1]["times"] == t and found[-1]["last"] == lo:
                        found[-1]["last"] = hi
                    elif t:
                        found.append({"first": lo, "last": hi, "times": t})
            parts.append(found)
        pdf["taken"], pdf["segments"] = taken, parts
        return pdf[["k", "th", "size", "source_size", "target", "taken", "segments"]]

    narrow = placed.select("source_key", "shard", "k", "named", "th", "tie", "h", "size", "source_size", "target", "block")
    schema = "k string, th long, size long, source_size long, target double, taken long, segments array<struct<first:long,last:long,times:int>>"
    chosen = narrow.groupBy("source_key", "shard").cogroup(shards.groupBy("source_key", "shard")).applyInPandas(choose, schema)
    return chosen.select(F.col("k").cast(id_type).alias(row_col or id_col), F.col("th").alias("text_hash"), "size", "source_size", "target", "taken", "segments")
