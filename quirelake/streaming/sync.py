"""Keeping a folder in step with another: once, or as a stream of new files.

A file stream reports a path once. ``sync_changed`` compares listings by time and size instead, so files that change
under their name are sent again; ``poll`` repeats it. Sources are read by Hadoop's file systems; a target is a folder that all
executors share or, with a scheme such as ``s3://``, a store that Arrow's file systems reach. Upload and download
are the same copy with the ends exchanged.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_FILES = "path string, modificationTime timestamp, length long, content binary"


def write_files(rows: DataFrame, target: str, store: dict | None = None) -> None:
    """Each row (relative, content) as a file below ``target``, on the executors. In a folder it is written aside and renamed; a store shows
    a file when it is whole. ``store`` has the options of a bucket: endpoint, access_key, secret_key."""

    def put(part) -> None:
        import uuid

        files = None
        for row in part:
            name = os.path.normpath(row.relative)
            if name.startswith(("..", "/")):
                raise ValueError(f"{row.relative} leads out of the target")
            if "://" in target and not target.startswith("file:"):
                if files is None:
                    files, base = _store(target, store or {})
                with files.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(row.content))
                continue
            path = os.path.join(target.removeprefix("file://"), name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            aside = f"{path}.{uuid.uuid4().hex}.part"
            with open(aside, "wb") as out:
                out.write(bytes(row.content))
            os.replace(aside, path)

    rows.foreachPartition(put)


def _store(target: str, options: dict):
    """Arrow's file system of a target, and the path in it."""
    from pyarrow import fs

    scheme, _, path = target.partition("://")
    if scheme in ("s3", "s3a") and options:
        return fs.S3FileSystem(access_key=options.get("access_key"), secret_key=options.get("secret_key"), endpoint_override=options.get("endpoint")), path.rstrip("/")
    files, path = fs.FileSystem.from_uri(target)
    return files, path.rstrip("/")


def _relative(source: str):
    start = source.split("://", 1)[-1].rstrip("/")
    return F.regexp_replace(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(start), F.lit("")), "^/+", "")


def stream_files(spark: SparkSession, source: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "5 minutes") -> StreamingQuery:
    """Hands new files to ``sink`` as (relative, content, modificationTime, length); ``every`` None: all there are, then it ends."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(source)
    named = files.withColumn("relative", _relative(source)).where(~F.col("relative").endswith("/"))
    writer = named.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def sync_once(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Copies what is new since the last call with this checkpoint."""
    stream_files(spark, source, lambda rows, _: write_files(rows, target), checkpoint, None).awaitTermination()


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of a listing (relative, modified, size) that are new or not as they were."""
    return now.join(before, ["relative", "modified", "size"], "left_anti")


def sync_changed(spark: SparkSession, source: str, target: str, state: str, store: dict | None = None, prefix: str = "") -> int:
    """Copies the files that are new or changed since the listing in ``state``, then puts the new listing there; how many were copied."""
    from quirelake.session import cut, forget
    from quirelake.sources.structure import folder_exists, listing

    now = cut(listing(spark, source, prefix), "listing")
    before = spark.read.parquet(state) if folder_exists(spark, state) else None
    todo = cut(changed(now, before) if before is not None else now, "changed-files")
    n = todo.count()
    if n:
        base = f"{source.rstrip('/')}/{prefix.strip('/')}".rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        write_files(files.withColumn("relative", _relative(base)).join(todo.select("relative"), "relative", "left_semi").select("relative", "content"), target, store)
        now.write.mode("overwrite").parquet(state)
    forget(todo)
    forget(now)
    return n


def poll(spark: SparkSession, source: str, target: str, state: str, seconds: float = 300.0, rounds: int | None = None, store: dict | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """``sync_changed`` every ``seconds``, for ever or for some rounds."""
    n = 0
    while rounds is None or n < rounds:
        if n:
            sleep(seconds)
        sync_changed(spark, source, target, state, store)
        n += 1


def tumbling(events: DataFrame, width: str = "5 minutes", time_col: str = "ts") -> DataFrame:
    """Events in each window of that width: window_start, n. On a stream, put a watermark before it."""
    return events.groupBy(F.window(time_col, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")
