"""Configuration, book structures and listings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "STRUCT<page_number: STRING>"
_SUB = "STRUCT<title: STRING, start_page: STRING, end_page: STRING, level: STRING>"
STRUCTURE = (
    f"cover_page {_PAGE}, table_of_contents STRUCT<start_page: STRING, end_page: STRING, entries: ARRAY<STRUCT<title: STRING, page_number: STRING, level: STRING>>>, "
    f"chapters ARRAY<STRUCT<title: STRING, start_page: STRING, end_page: STRING, level: STRING, subchapters: ARRAY<{_SUB}>>>, back_cover {_PAGE}, _corrupt STRING"
)


@dataclass(frozen=True)
class Config:
    title: str | None = None
    target_title: str | None = None
    author: str | None = None
    model: str = "offline"
    target_language: str = "Chinese"
    source_language: str = "English"
    num_retries: int = 3
    max_backoff_seconds: float = 30.0
    previous_content_limit: int = 0
    max_continuation_attempts: int = 3


def load_config(path: str, **given) -> Config:
    """A file's settings under those given (those that are not None), over the defaults. Unknown keys are left out."""
    import yaml

    with open(path, encoding="utf-8") as source:
        found = yaml.safe_load(source) or {}
    names = {f.name for f in fields(Config)}
    merged = {k: v for k, v in found.items() if k in names and v is not None}
    return Config(**(merged | {k: v for k, v in given.items() if k in names and v is not None}))


def config_value(path: str, key: str) -> str | None:
    """A setting as stripped text: a missing key is empty, an explicit null is ``None``; None where the file can't be read."""
    import yaml

    try:
        with open(path, encoding="utf-8") as source:
            found = yaml.safe_load(source)
        return str(found.get(key, "")).strip()
    except Exception:  # noqa: BLE001  any failure means: no value
        return None


def parse_structure(frame: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``structure``; page numbers and levels are read as text and cast, since models quote them. A text that isn't
    JSON has it in ``structure._corrupt``."""
    raw = F.from_json(F.col(text_col), STRUCTURE, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    number = lambda c: c.try_cast("int")

    def entry(c):
        return [c["title"].alias("title"), number(c["start_page"]).alias("start_page"), number(c["end_page"]).alias("end_page"), F.coalesce(number(c["level"]), F.lit(1)).alias("level")]

    none = F.array().cast("array<struct<title:string,start_page:int,end_page:int,level:int>>")
    sub = lambda c: F.coalesce(F.transform(c["subchapters"], lambda s: F.struct(*entry(s))), none)
    toc = F.col("_raw.table_of_contents")
    typed = F.struct(
        number(F.col("_raw.cover_page.page_number")).alias("cover_page"), number(F.col("_raw.back_cover.page_number")).alias("back_cover"),
        number(toc["start_page"]).alias("toc_start"), number(toc["end_page"]).alias("toc_end"),
        F.transform(toc["entries"], lambda e: F.struct(e["title"].alias("title"), number(e["page_number"]).alias("page_number"), F.coalesce(number(e["level"]), F.lit(1)).alias("level"))).alias("entries"),
        F.transform("_raw.chapters", lambda c: F.struct(*entry(c), sub(c).alias("subchapters"))).alias("chapters"), F.col("_raw._corrupt").alias("_corrupt"),
    )
    return frame.withColumn("_raw", raw).withColumn("structure", typed).drop("_raw")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """book (the file's path) and structure of every JSON file below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return parse_structure(files.select(F.col("_metadata.file_path").alias("book"), F.col("value").alias("text"))).drop("text")


def write_structures(structures: DataFrame, path: str) -> None:
    structures.write.mode("overwrite").json(path)


def listing(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """relative, modified, size of the files below ``path/prefix``, without reading them. A prefix ends at a folder's
    edge; folder markers and names that lead upwards are left out."""
    base = f"{path.rstrip('/')}/{prefix.strip('/')}".rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^file:/+", "/")
    start = base.split("://", 1)[-1] if base.startswith("file:") else base
    relative = F.regexp_replace(F.replace(plain, F.lit(start), F.lit("")), "^/+", "")
    rows = files.select(relative.alias("relative"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.where(~F.col("relative").endswith("/") & ~F.col("relative").rlike(r"(^|/)\.\.(/|$)"))


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or bucket can be reached, by Hadoop's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))
