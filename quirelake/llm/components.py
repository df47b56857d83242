"""Connected components of a link table, by alternating large and small stars.

Each round halves, roughly, the height of the trees; links live in written tables only. Minima are
partial aggregates, so a node with very many links adds one row per task to the shuffle that finds
its minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.session import cut, forget


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` has long columns a and b; returns node, root (its component's smallest node) for
    every node with a link to another. Repeated links, loops and either direction are fine; an
    empty table gives no rows; null ends are dropped."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(edges.distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = cut(small.distinct(), "small-star")
        forget(large)
        forget(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
