"""Joins, orders and picks that book flows are made of, each in the form that spreads over a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.session import cut


def missing_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner. A null key has none (``NOT IN`` would lose every row)."""
    return left.join(right.select(*on), on, "left_anti")


def append_missing(tracked: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """``tracked`` and, with ``tracked`` false, what was found and is not there yet."""
    known = tracked.select(*on).distinct().withColumn("tracked", F.lit(True))
    new = missing_from(found.select(*on).distinct(), tracked, on).withColumn("tracked", F.lit(False))
    return known.unionByName(new)


def first_by(frame: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """One row per key: the first in the given order. A minimum, so a key with very many rows is
    reduced before the shuffle. Order columns must settle ties."""
    least = F.min(F.struct(*order, *[c for c in take if c not in order]))
    return frame.groupBy(*keys).agg(least.alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in take])


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], take: list[str]) -> DataFrame:
    """``left`` with the first partner's columns, null without one."""
    return left.join(first_by(right, on, order, take), on, "left")


def last_by(frame: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """One row per key: the last in the given order."""
    most = F.max(F.struct(*order, *[c for c in take if c not in order]))
    return frame.groupBy(*keys).agg(most.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in take])


def largest(frame: DataFrame, keys: list[str], area: Column, tie: str, take: list[str]) -> DataFrame:
    """One row per key: the largest area above 0, the smallest ``tie`` among equals."""
    rated = frame.withColumn("_area", area).where(F.col("_area") > 0).withColumn("_back", -F.col("_area"))
    return first_by(rated, keys, ["_back", tie], take)


def ordinals(frame: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Numbers rows from 1 within each key in the given order, which must settle ties.

    A window by key would sort all rows of a hot key in one task. Here rows are dealt by ranges of key and
    order, numbered within a range, and moved up by the counts of the ranges before, one row each.
    """
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    moved = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(moved, same).withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
    return out.select(*frame.columns, name)


def batches(frame: DataFrame, keys: list[str], order: list[str], size: int = 10) -> DataFrame:
    """Adds ordinal and batch: fixed sizes, the last one short, counted from 0."""
    return ordinals(frame, keys, order).withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("long"))


def zipped(items: Column, answers: Column) -> Column:
    """``answers`` by position; where there is none, the item itself; surplus answers are ignored."""
    return F.transform(items, lambda x, i: F.coalesce(F.try_element_at(answers, (i + 1).cast("int")), x))


def joined_text(frame: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "") -> DataFrame:
    """Ordered concatenation of the non-empty texts of each key."""
    parts = frame.where(F.length(text) > 0)
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_t"]), separator).alias(text))


def page_windows(chapters: DataFrame, pages: DataFrame, book: str = "book", buffer: int = 3) -> DataFrame:
    """Pages of each chapter, ``buffer`` more on either side, within the book.

    Chapters have book, chapter, start_page, end_page (from 1); pages have book, page_no. The range
    becomes rows and an equi-join, never a nested loop. A start after the end gives no pages.
    """
    first, last = F.greatest(F.col("start_page") - buffer, F.lit(1)), F.col("end_page") + buffer
    wanted = F.when((F.col("start_page") <= F.col("end_page")) & (first <= last), F.sequence(first.cast("long"), last.cast("long")))
    rows = chapters.select(book, "chapter", "start_page", F.explode(wanted).alias("page_no"))
    return rows.join(pages, [book, "page_no"])


def with_previous(frame: DataFrame, keys: list[str], order: list[str], text: str, limit: int, name: str) -> DataFrame:
    """Keys, order and ``name``: the first ``limit`` characters of the text before, in order; empty at the start, with no limit,
    or where that text is null. The order must settle ties. The row before is met by its number, a join of equals; a window would
    sort a hot key in one task."""
    starts = cut(frame.select(*keys, *order, F.coalesce(F.left(text, F.lit(max(limit, 0))), F.lit("")).alias("_start")), "starts")
    rows = ordinals(starts, keys, order, "_n")
    rows = cut(rows, "numbered")
    before = rows.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_n") + 1).alias("_next"), F.col("_start").alias("_before"))
    same = F.col("_n") == F.col("_next")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(before, same, "left").select(*keys, *order, F.coalesce("_before", F.lit("")).alias(name))


def first_fit(size: Column, rungs: list[float], bound: float) -> Column:
    """Number (from 0) of the first rung whose share of the size fits the bound, -1 if none does.
    Each rung is measured from the original."""
    out = F.lit(-1)
    for i in range(len(rungs) - 1, -1, -1):
        out = F.when(size * rungs[i] <= bound, F.lit(i)).otherwise(out)
    return out


def size_stats(input_size: Column, output_size: Column) -> Column:
    """Sizes in MB, their ratio, and what was saved in percent; null ratio where the output is empty."""
    mb = 1048576.0
    return F.struct(
        (input_size / mb).alias("input_size_mb"), (output_size / mb).alias("output_size_mb"),
        F.try_divide(input_size.cast("double"), output_size.cast("double")).alias("compression_ratio"),
        (F.try_divide((input_size - output_size).cast("double"), input_size.cast("double")) * 100).alias("saved_percentage"),
    )
