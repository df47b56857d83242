"""Archives as rows: one row per member on reading, one archive per book on writing."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "book string, ord int, member string, compress_type int, content binary, error string"
MOST_BYTES = 256 << 20  # of one member, unpacked


def safe_name(name: str) -> str | None:
    """A member's name with forward slashes, or None where it would leave the archive's folder."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".")]
    bad = name.startswith(("/", "\\")) or ".." in parts or (parts and len(parts[0]) == 2 and parts[0][1] == ":")
    return None if bad or not parts else "/".join(parts)


def unpack(raw: bytes, most: int = MOST_BYTES) -> Iterator[tuple[int, str, int, bytes | None, str | None]]:
    """ord, member, compress_type, content, error of each file in an archive."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for i, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
            name = safe_name(info.filename)
            if name is None:
                yield i, info.filename, info.compress_type, None, "unsafe name"
                continue
            with archive.open(info) as member:
                content = member.read(most + 1)
            yield (i, name, info.compress_type, None, "too large") if len(content) > most else (i, name, info.compress_type, content, None)


def members_of(archives: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Member rows of archives (book, content); a broken archive is one row with its error."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for book, raw in zip(pdf["book"], pdf["content"], strict=True):
                rows = []
                try:
                    for row in unpack(bytes(raw), most):
                        rows.append((book, *row))
                except (zipfile.BadZipFile, OSError, EOFError, ValueError, TypeError, RuntimeError, NotImplementedError) as problem:
                    rows.append((book, None, None, None, None, str(problem)))
                yield pd.DataFrame(rows, columns=["book", "ord", "member", "compress_type", "content", "error"]).astype({"ord": "Int32", "compress_type": "Int32"})

    return archives.select("book", "content").mapInPandas(read, MEMBERS)


def read_archives(spark: SparkSession, path: str, pattern: str = "*.epub") -> DataFrame:
    """Member rows of all archives below a folder; book is the file's path below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return members_of(files.select(F.col("path").alias("book"), "content"))


def pack(members: list[tuple[str, bytes]]) -> bytes:
    """An archive: ``mimetype`` first and stored, the others deflated in order of name, with fixed times, so equal members give equal bytes."""
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as archive:
        for name, content in sorted(members, key=lambda m: (m[0] != "mimetype", m[0])):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, content)
    return sink.getvalue()


def archives_of(members: DataFrame) -> DataFrame:
    """book, content: one archive for each book. Members of one book meet in one task, as their archive must; books are independent."""

    def write(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        unique = {m: bytes(c) for m, c in zip(pdf["member"], pdf["content"], strict=True) if c is not None and safe_name(m) == m}
        return pd.DataFrame({"book": [keys[0]], "content": [pack(list(unique.items()))]})

    rows = members.select("book", "member", F.col("content").cast("binary").alias("content"))
    return rows.groupBy("book").applyInPandas(write, "book string, content binary")


def html_members(members: DataFrame, xhtml: bool = False) -> DataFrame:
    """Members named ``*.htm*``; ``.xhtml`` only if asked for."""
    pattern = r"\.x?htm[^/]*$" if xhtml else r"(^|/)[^/]*\.htm[^/]*$"
    return members.where(F.col("member").rlike(pattern))


def first_member(members: DataFrame, name: str) -> DataFrame:
    """The member of that file name with the smallest path in each book."""
    named = members.where(F.substring_index("member", "/", -1) == name)
    least = named.groupBy("book").agg(F.min("member").alias("member"))
    return named.join(least, ["book", "member"])
