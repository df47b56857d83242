"""Resume by checkpoint rows: append what was done, read the latest by key, go on with the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators.relational import last_by, missing_from

SCHEMA = "book string, kind string, item string, ordinal long, done boolean, content string, at timestamp"


def latest(log: DataFrame) -> DataFrame:
    """The last state of each item; equal times are settled by done, then content."""
    return last_by(log, ["book", "kind", "item"], ["at", "done", "content"], ["at", "done", "content", "ordinal"])


def pending(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items (book, kind, item, …) that no checkpoint calls done. By item, not by frontier, so
    that what was skipped is tried again."""
    return missing_from(items, latest(log).where("done"), ["book", "kind", "item"])


def frontier(log: DataFrame) -> DataFrame:
    """The highest ordinal done for each book and kind, -1 without one."""
    done = F.max(F.when(F.col("done"), F.col("ordinal")))
    return latest(log).groupBy("book", "kind").agg(F.coalesce(done, F.lit(-1)).alias("frontier"))


def append(rows: DataFrame, path: str) -> None:
    rows.select("book", "kind", "item", "ordinal", "done", "content", "at").write.mode("append").parquet(path)


def overlay(*values: Column) -> Column:
    """Command line over configuration over default: the first that is set."""
    return F.coalesce(*values)
