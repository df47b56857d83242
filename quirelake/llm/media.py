"""Media columns: FLAC streams in a binary column, decoded to PCM blocks with sample offsets.

A stream is decoded frame by frame (Rice residuals, fixed and linear predictors, both checksums) to blocks that name
the sample they begin at. ``block_lists`` holds a stream's blocks in one row, ``decode_blocks`` one block a row,
``write_blocks`` writes these in order, and ``read_samples`` seeks: it takes the blocks that a range of samples touches.

Defined results: a null payload or stream gives no blocks and a null stream; a null text is stored as an empty one; a
damaged stream gives the blocks before the damage with ``ok`` false; repeated rows are coded each, equal inputs to equal
bytes; columns other than the id and the text or stream are not read, so their names don't matter; an empty table gives
no rows. No shuffle. Batches are coded in parts of ``PART`` bytes and a long text in slices of whole frames, so a text
of any length takes its own bytes a few times and the working memory of one slice.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm import flac

PART = 1 << 20
ALIGN = 64
_BLOCKS = "array<struct<sample_offset:bigint,n_samples:int,pcm:binary>>"


def _parts(values: list) -> Iterator[slice]:
    first, size = 0, 0
    for i, v in enumerate(values):
        size += len(v) if v is not None else 0
        if size >= PART:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(values):
        yield slice(first, len(values))


def padded(text: str | None) -> bytes:
    """UTF-8 bytes and zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(ALIGN - len(raw) % ALIGN if not raw or len(raw) % ALIGN else 0)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media: the padded text as a FLAC stream of 8-bit samples."""
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _parts(texts):
                sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts[part]]
                streams = flac.encode([padded(t) for t in texts[part]], linear=flac.LINEAR)
                yield pa.RecordBatch.from_pydict({"k": batch.column(0)[part], "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(streams, pa.binary())})

    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(write, f"k {kind}, n_bytes long, media binary")
    return rows.withColumnRenamed("k", id_col)


def feature(samples: np.ndarray) -> str:
    """Length, peak, energy, crossings of zero and a quarter-wise level, in whole numbers."""
    if not len(samples):
        return "0"
    n, peak, energy, crossings = len(samples), 0, 0, 0
    for at in range(0, n, PART):
        x = samples[max(at - 1, 0) : at + PART].astype(np.int32)
        crossings += int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
        own = x[1:] if at else x
        peak, energy = max(peak, int(np.abs(own).max())), energy + int((own * own).sum(dtype=np.int64))
    quarters = [int(np.abs(q.astype(np.int16)).sum(dtype=np.int64)) // max(len(q), 1) for q in np.array_split(samples, 4)]
    return f"{n}|{peak}|{energy}|{crossings}|{','.join(map(str, quarters))}"


def block_lists(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, blocks (sample_offset, n_samples, pcm: signed bytes, or little-endian pairs above 8 bits), ok (of the whole stream),
    and the columns ``carry``; null blocks and ok for a null stream."""
    fields = media.schema
    kinds = "".join(f", c{i} {fields[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = batch.column(1).to_pylist()
            for part in _parts(streams):
                present = iter(flac.decode([s for s in streams[part] if s is not None]))
                at, counts, pcm, edges, oks = [], [], [], [0], []
                for s in streams[part]:
                    d = next(present) if s is not None else None
                    oks.append(d.ok if d else None)
                    for offset, n in d.blocks if d else ():
                        at.append(offset)
                        counts.append(n)
                        pcm.append(d.samples[offset : offset + n].astype(np.int8 if d.bits <= 8 else "<i2").tobytes())
                    edges.append(len(at))
                fields = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(counts, pa.int32()), pa.array(pcm, pa.binary())], ["sample_offset", "n_samples", "pcm"])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), fields, mask=pa.array([o is None for o in oks]))
                rest = {f"c{i}": batch.column(2 + i)[part] for i in range(len(carry))}
                yield pa.RecordBatch.from_pydict({"k": batch.column(0)[part], "blocks": lists, "ok": pa.array(oks, pa.bool_())} | rest)

    kind = fields[id_col].dataType.simpleString()
    plain = media.select(F.col(id_col).alias("k"), F.col(media_col).alias("m"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    rows = plain.mapInArrow(read, f"k {kind}, blocks {_BLOCKS}, ok boolean{kinds}")
    return rows.select(F.col("k").alias(id_col), "blocks", "ok", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def decode_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: id, sample_offset, n_samples, pcm, ok (of the stream)."""
    return block_lists(media, id_col, media_col).select(id_col, F.explode("blocks").alias("b"), "ok").select(id_col, "b.sample_offset", "b.n_samples", "b.pcm", "ok")


def write_blocks(media: DataFrame, path: str, id_col: str = "doc_id", media_col: str = "media") -> None:
    """The blocks as Parquet, by id and offset within each file, so a reader that seeks skips row groups by their statistics."""
    decode_blocks(media, id_col, media_col).sortWithinPartitions(id_col, "sample_offset").write.parquet(path)


def touches(first: int, count: int) -> Column:
    """Whether a block has one of the ``count`` samples from ``first`` on; the upper bound is pushed down to the scan."""
    return (F.col("sample_offset") < first + count) & (F.col("sample_offset") + F.col("n_samples") > first)


def read_samples(blocks: DataFrame, first: int, count: int, id_col: str = "doc_id") -> DataFrame:
    """id, pcm of the 8-bit samples from ``first`` to ``first + count``, or as far as the stream goes: only blocks that hold some are read."""
    cut = F.substring("pcm", F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0)).cast("int") + 1, F.lit(count + first) - F.greatest("sample_offset", F.lit(first)))
    parts = blocks.where(touches(first, count)).select(id_col, "sample_offset", cut.alias("p"))
    listed = F.array_sort(F.collect_list(F.struct("sample_offset", "p")))
    return parts.groupBy(id_col).agg(F.aggregate(listed, F.lit(b""), lambda acc, x: F.concat(acc, x["p"])).alias("pcm"))


def _payload(blocks: list[dict]) -> tuple[bytes, bytes]:
    """All samples as unsigned bytes, and the last ``ALIGN`` of them, found by the blocks' offsets."""
    total, starts = 0, []
    for b in blocks:
        if b["sample_offset"] != total or b["n_samples"] != len(b["pcm"]):
            raise ValueError("blocks with a gap")
        starts.append(total)
        total += b["n_samples"]
    flip = lambda raw: (np.frombuffer(raw, np.uint8) ^ 128).tobytes()
    i = max(int(np.searchsorted(starts, total - ALIGN, side="right")) - 1, 0)
    tail = b"".join(b["pcm"] for b in blocks[i:])[-ALIGN:]
    return flip(b"".join(b["pcm"] for b in blocks)), flip(tail)


def digest(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from the PCM blocks of the stored bytes; fails where a checksum doesn't hold."""
    kind = media.schema[id_col].dataType.simpleString()
    stored = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    lists = block_lists(stored, id_col, "media", ("n_bytes", "media_bytes", "media_sha256"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, tails, features = [], [], [], []
            for key, ok, blocks in zip(batch.column("k"), batch.column("ok").to_pylist(), batch.column("blocks"), strict=True):
                if not ok:
                    raise ValueError(f"stream of {key}: damaged")
                payload, tail = _payload(blocks.as_py())
                sizes.append(len(payload))
                sums.append(hashlib.sha256(payload).hexdigest())
                tails.append(zlib.crc32(tail))
                features.append(feature((np.frombuffer(payload, np.uint8) ^ 128).view(np.int8)))
            long = lambda values: pa.array(values, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "k": batch.column("k"), "n_bytes": batch.column("n_bytes"), "payload_bytes": long(sizes), "payload_sha256": pa.array(sums, pa.string()), "tail_crc32": long(tails),
                "media_bytes": batch.column("media_bytes"), "media_sha256": batch.column("media_sha256"), "feature": pa.array(features, pa.string()),
            })

    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return lists.withColumnRenamed(id_col, "k").mapInArrow(read, schema).withColumnRenamed("k", id_col)
