"""Packing by power-of-two decomposition.

A document of L ids becomes floor(L / max) pieces of ``max_len`` ids and one piece for each set
bit of the rest, longest first. Every piece is a sequence of its own, so no sequence crosses
documents; pieces of equal length form a bucket and nothing is padded. One pass, no shuffle.

Ids are those of the tokenizer for the whole text. The tokenizer drops white space and never
joins across it, so a text is encoded word by word through a bounded cache in each worker.

Defined results: a null or empty text is the closing id alone; a null id stays null; repeated rows
are packed each. ``sequence_id`` is unique and follows partition and row order. Other columns aren't read, so their names
don't matter; an empty table gives no rows; a text of any length is one row of one task, encoded as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEN = 2048
END_ID = 1
CACHE_WORDS = 400_000
CACHE_BYTES = 32 << 20
PART_CHARS = 1_000_000  # texts looked at together
_TRAIL = b".,!?;:|*$%&#"
_SUFFIX = "</w>"  # of tokens that end a word
_WIDE = re.compile("[^\0-\u024f]")  # marks that join letters lie beyond

_CACHES: dict[str, "WordIds"] = {}


class WordIds(dict):
    """word bytes -> its ids as little-endian unsigned 32-bit bytes, for the words seen last.

    The tokenizer lower-cases and cuts between letters and punctuation. So texts are lower-cased
    first where no mark could join a letter, and a word gets its ids from its core and trailing marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.held = Tokenizer.from_file(path), 0
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(_SUFFIX)]] = True

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        words = [_low(t).split() if t else [] for t in texts]
        if len(self) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.forget()
        missing = [w for w in set().union(*words) if w not in self]
        pairs = {}
        for w in missing:
            core = w.rstrip(_TRAIL)
            if len(core) < len(w) and _ends_with_letter(core):
                pairs[w] = core, w[len(core) :]
        self._encode({part for pair in pairs.values() for part in pair if part not in self} | {w for w in missing if w not in pairs})
        for w, (core, trail) in pairs.items():
            self[w] = self[core] + self[trail]
        self.held += sum(map(len, missing))
        return [b"".join(map(self.__getitem__, w)) for w in words]

    def _encode(self, words: set[bytes]) -> None:
        """All words in one go: those of one kind of character, which end with the first token that ends a word, then the others."""
        plain, mixed = [], []
        for w in words:
            t = w.decode("utf-8")
            (plain if t.isalpha() or not w.strip(_TRAIL) else mixed).append((w, t))
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            found = self.tokenizer.encode_batch_fast([" ".join(t for _, t in part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):  # every word has one end at least, so each has exactly one
                self._keep(part, ids, np.concatenate([[0], ends]))
            else:
                mixed += part
        for at in range(0, len(mixed), 20_000):
            part = mixed[at : at + 20_000]
            found = self.tokenizer.encode(" ".join(t for _, t in part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for _, t in part])
            tokens = np.array([o[0] for o in found.offsets], np.int64)  # a token belongs to the word that holds its start
            self._keep(part, np.array(found.ids, "<u4"), np.searchsorted(tokens, starts))

    def _keep(self, part: list[tuple[bytes, str]], ids: np.ndarray, edges: np.ndarray) -> None:
        raw, edges = ids.tobytes(), (4 * edges).tolist()
        for (w, _), first, last in zip(part, edges[:-1], edges[1:], strict=True):
            self[w] = raw[first:last]


def _low(text: str) -> bytes:
    """The text in bytes, A-Z lower-cased where neither a composed letter nor a control token can depend on it."""
    raw = text.encode("utf-8")
    return raw if "<|" in text or not (text.isascii() or _WIDE.search(text) is None) else raw.lower()


def _ends_with_letter(core: bytes) -> bool:
    """Whether the last character is an ASCII letter or digit or one of the letters from U+00C0 to U+00FF."""
    return core[-1:].isalnum() or (core[-2:-1] == b"\xc3" and core[-1:] not in (b"\x97", b"\xb7"))


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def _parts(texts: list[str | None]) -> Iterator[slice]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= PART_CHARS:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def piece_lengths(total: int, max_len: int = MAX_LEN) -> list[int]:
    """Binary decomposition of ``total`` with pieces of at most ``max_len`` (a power of two)."""
    whole, rest = divmod(total, max_len)
    return [max_len] * whole + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
    end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket [, ids]. A bucket has the number
    of its sequences' length: 2 to its power."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_ids(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in _parts(texts):
                who, starts, lengths, sums, totals, pieces = [], [], [], [], [], []
                for i, raw in enumerate(vocabulary.texts(texts[part]), part.start):
                    raw += end
                    total, at = len(raw) // 4, 0
                    for n in piece_lengths(total, max_len):
                        piece = raw[4 * at : 4 * (at + n)]
                        who.append(i)
                        starts.append(at)
                        lengths.append(n)
                        sums.append(zlib.crc32(piece))
                        totals.append(total)
                        if with_ids:
                            pieces.append(piece)
                        at += n
                long = lambda values: pa.array(values, pa.int64())
                out = {"k": keys.take(pa.array(who, pa.int64())), "start": long(starts), "length": long(lengths), "ids_crc32": long(sums), "doc_tokens": long(totals), "offset": long([0] * len(who))}
                yield pa.RecordBatch.from_pydict(out | ({"raw": pa.array(pieces, pa.binary())} if with_ids else {}))
        vocabulary.forget()  # workers live on; a next task's words are mostly others

    schema = f"k {id_type}, start long, length long, ids_crc32 long, doc_tokens long, offset long" + ", raw binary" * with_ids
    packed = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInArrow(pack, schema)
    packed = packed.withColumn("sequence_id", F.monotonically_increasing_id())
    names = [F.col("k").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.log2("length").cast("int").alias("bucket")]
    return packed.select(*names, *(["raw"] if with_ids else []))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences with one folder per bucket, so that a reader batches equal lengths without padding."""
    packed.write.partitionBy("bucket").parquet(path)
