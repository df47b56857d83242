"""Session helpers that every part of the library shares.

``ship`` makes the package importable on executors, ``scratch_root`` names the folder that all
executors share, and ``cut`` ends a lineage by writing a table there.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (the driver serves the archive), and bound
    the batches that go to Python workers: at Spark's own 64 MB, long texts fill an executor's memory several times over."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "64m") in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    if getattr(sc, "_quirelake_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quirelake-")) / "quirelake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._quirelake_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``. Where that is unset, a local one if all runs on this machine (tests); else it is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(sc, "_quirelake_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="quirelake-scratch-")
            sc._quirelake_scratch = root
    return root.rstrip("/")


def cut(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that neither a lost
    executor nor a later action computes it again. The path is kept on the result for ``forget``."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quirelake/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quirelake_path = path
    written(path)
    return out


def written(path: str) -> None:
    """Tells ``scratch`` of a table in the shared folder."""
    for paths in _SCOPES:
        paths.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete the table behind a result of ``cut``; what was read from it can't be computed any more."""
    path = getattr(df, "_quirelake_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that ``cut`` writes, or ``written`` tells of, inside the block when it ends, but for those given to the function that it hands out."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df._quirelake_path)
        return df

    _SCOPES.append(paths)
    try:
        yield keep
    finally:
        _SCOPES[:] = [p for p in _SCOPES if p is not paths]
        for path in paths:
            _delete(spark, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


