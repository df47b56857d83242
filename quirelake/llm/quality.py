"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Symbols are the 256 bytes of UTF-8 and a pad before each text, so an n-gram of order 5 is a whole number of 45 bits and
nothing is hashed. Counts cover all trusted text, and neither they nor the model are bounded, collected or broadcast:

1. Documents are put into a table of chunks of some MB, bucketed by chunk. It is the only copy of the texts.
2. Counts of trusted text are added up in each task, then by key. Lower orders count distinct left neighbours. A record of
   the model has an n-gram's count and, as a context, its total and how many n-grams it begins that occur once, twice and more often.
3. A chunk asks for the records of its distinct n-grams, one blob for each shard of the keys; a shard answers with those
   that it has. So common n-grams cost one key a chunk, no key is hot, and no document is spread out into its n-grams.
4. Answers are shuffled to the chunks, whose buckets stay where they are. A chunk computes the probability of each of its
   distinct n-grams once, and its documents' perplexities from these.

The model of all trusted text judges the documents. Thresholds come from models that leave out one of ``FOLDS`` folds each
(by the MD5 of the text, so copies share a fold) and score the trusted documents of that fold. A language's threshold is the
``quantile`` of its n trusted documents' perplexities, drawn to that of all trusted documents in the ratio
n to ``smoothing``, so a language without trusted text has the latter. A document over its language's threshold
is rejected. A few bytes say little: perplexity is that of the text and ``prior`` bytes more at the mean of the trusted documents.

Defined results: a null or empty text has the trusted mean's perplexity and is kept; null is a language apart from '' and
any other; repeated rows are judged each, copies alike; a text of any length is scored as a whole; without trusted text every
document is kept with null perplexity and threshold; an empty table gives no rows. Columns of the input come back as they are;
the three new ones must not clash with them (``ValueError``).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quirelake.session import cut, forget, fresh, scratch_root, tidy, written

ORDER = 5
SYMBOL = 9  # bits: 0 is the pad, a byte b is b + 1
_TAG = SYMBOL * ORDER  # the order is written above the symbols
QUANTILE = 0.995
SMOOTHING = 30.0
FOLDS = 2
PRIOR = 40.0
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
SHARD_RECORDS = 500_000
SHARD_KEYS = 3_000_000
BROADCAST_ROWS = 4_000_000
ZSTD_LEVEL = 6  # of the chunks
_PART = 1 << 63 - _TAG  # a place in a part fits beside an n-gram
_LEAST_CHUNK = 1 << 20
_ALL = -1  # the model of all folds; others have the number of the fold that they leave out
_FIELDS = ("n", "total", "once", "twice", "more")


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts, and the texts' edges; null texts are empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


def ngrams(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The n-gram of the highest order that ends at each byte, with pads before each text."""
    line = raw.astype(np.int64)
    line += 1
    key = line.copy()
    for back in range(1, ORDER):
        line <<= SYMBOL
        key[back:] |= line[:-back]
    sizes = np.diff(edges)
    for at in range(ORDER - 1):  # what reaches into the text before is pads
        key[edges[:-1][sizes > at] + at] &= (1 << SYMBOL * (at + 1)) - 1
    return key


def _first(values: np.ndarray) -> np.ndarray:
    """Whether each of these sorted values differs from the one before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting integers takes less than hashing them, as ``np.unique`` does."""
    values = np.sort(values)
    return values[_first(values)]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    at = np.flatnonzero(_first(values))
    return values[at], np.diff(at, append=len(values))


def _parts(raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the text that a part starts in, n-grams, edges of texts among them) for parts of some bytes; a long text has many."""
    at, end, gap = 0, int(edges[-1]), ORDER - 1
    while at < end:
        to = min(at + _PART, end)
        first = int(np.searchsorted(edges, at, side="right")) - 1
        last = int(np.searchsorted(edges, to, side="left"))
        inner = np.clip(edges[first : last + 1], at, to) - at
        before = min(gap, at - int(edges[first]))  # bytes of the same text in the part before
        keys = ngrams(raw[at - before : to], np.concatenate([[0], inner[1:] + before]))[before:]
        yield first, keys, inner
        at = to


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    """Record keys of the last ``order`` symbols."""
    return (keys & ((1 << SYMBOL * order) - 1)) | (order << _TAG)


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    """Record keys of the context of an n-gram's last ``order`` symbols."""
    return ((keys & ((1 << SYMBOL * order) - 1)) >> SYMBOL) | ((order - 1) << _TAG)


def asked(keys: np.ndarray) -> np.ndarray:
    """Sorted record keys that the probabilities of these distinct n-grams need."""
    suffixes = {ORDER: keys}  # sorted, and so are their contexts
    for order in range(ORDER - 1, 0, -1):
        suffixes[order] = _unique(suffixes[order + 1] & ((1 << SYMBOL * order) - 1))
    out = []
    for order in range(ORDER + 1):
        found = [_context(suffixes[order + 1], order + 1)] if order < ORDER else []
        found = [c[_first(c)] for c in found] + ([_suffix(suffixes[order], order)] if order else [])
        out.append(_unique(np.concatenate(found)) if len(found) > 1 else found[0])
    return np.concatenate(out)


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in of)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, most: min(max(d, 0.01), most)
    return clip(1 - 2 * y * n2 / n1, 0.99), clip(2 - 3 * y * n3 / n2, 1.99), clip(3 - 4 * y * n4 / n3 if n3 else 1.0, 2.99)


def log_probabilities(keys: np.ndarray, known: np.ndarray, records: np.ndarray, cuts: list[tuple[float, float, float]]) -> np.ndarray:
    """Natural logarithms of the probabilities of n-grams. ``known`` are sorted record keys, ``records`` their rows of _FIELDS (zeros where
    the model has none), ``cuts`` the discounts by order."""
    grams, longer = {ORDER: keys}, {}  # the distinct n-grams of each order; where those of the next order have their last symbols among them
    for order in range(ORDER - 1, 0, -1):
        grams[order], longer[order] = np.unique(grams[order + 1] & ((1 << SYMBOL * order) - 1), return_inverse=True)
    p = np.full(len(grams[1]), 1 / 256)
    for order, d in enumerate(cuts, 1):
        p = p[longer[order - 1]] if order > 1 else p
        own = records[np.searchsorted(known, _suffix(grams[order], order)), 0]
        context = _context(grams[order], order)
        new = _first(context)  # sorted n-grams of one context are neighbours
        total, once, twice, more = records[np.searchsorted(known, context[new])[np.cumsum(new) - 1], 1:].T
        left = np.where(own > 0, own - np.array([0.0, *d])[np.minimum(own, 3)], 0.0)
        p = np.where(total > 0, (left + (d[0] * once + d[1] * twice + d[2] * more) * p) / np.maximum(total, 1), p)
    return np.log(p)


def losses(raw: np.ndarray, edges: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Sum of negative log probabilities of each text; ``keys`` are the sorted distinct n-grams, ``logs`` theirs."""
    out = np.zeros(len(edges) - 1)
    for first, grams, inner in _parts(raw, edges):
        sizes = np.diff(inner)
        some = np.flatnonzero(sizes)
        bits = (len(grams) - 1).bit_length()
        order = np.sort(grams << bits | np.arange(len(grams)))  # n-grams with their places: each distinct one is searched once, in order
        grams, places = order >> bits, order & ((1 << bits) - 1)
        new = _first(grams)
        each = np.empty(len(grams))
        each[places] = logs[np.searchsorted(keys, grams[new])][np.cumsum(new) - 1]
        out[first + some] -= np.add.reduceat(each, inner[some])
    return out


def _distinct(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    parts = [_unique(grams) for _, grams, _ in _parts(raw, edges)]
    return _unique(np.concatenate([np.zeros(0, np.int64), *parts]))


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ZSTD_LEVEL))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def _bucketed(df: DataFrame, label: str, buckets: int, by: str) -> DataFrame:
    """``df`` written to the shared folder in buckets, so that joins by ``by`` leave it where it is. The catalogue forgets it at once."""
    spark, name = df.sparkSession, f"quirelake_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/quirelake/{label}-{name}"
    df.write.bucketBy(buckets, by).option("path", path).format("parquet").saveAsTable(name)
    written(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def chunked(docs: DataFrame, text_col: str, fold: DataFrame, chunk_bytes: int, buckets: int) -> DataFrame:
    """chunk, payload: the columns of ``docs`` and then the fold (-1: not trusted) of some MB of documents."""
    at = docs.columns.index(text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"payload": pa.array([_pack(pa.Table.from_batches(held))], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(at).nbytes
            if size >= chunk_bytes:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = docs.withColumn(fresh(docs, "fold")[0], fold).mapInArrow(write, "payload binary")
    return _bucketed(rows.withColumn("chunk", F.monotonically_increasing_id()), "chunks", buckets, "chunk")


def _texts(payload: pa.Scalar, at: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a chunk: all, or those of one fold."""
    table = _unpack(payload)
    text = table.column(at).cast(pa.large_string()).combine_chunks()
    if fold != _ALL:
        text = text.filter(pa.compute.equal(table.column(table.num_columns - 1).combine_chunks(), fold))
    return _buffer(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text)


def count_ngrams(chunks: DataFrame, at: int) -> DataFrame:
    """fold, key, n: how often each n-gram of the highest order occurs in the trusted text of a fold; a task adds up before it sends."""
    schema = "fold int, key long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {f: [] for f in range(FOLDS)}

        def add_up(pairs):
            keys, where = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate([n for _, n in pairs])).astype(np.int64)

        for batch in batches:
            for payload in batch.column(0):
                for fold, pairs in held.items():
                    pairs += [_counted(grams) for _, grams, _ in _parts(*_texts(payload, at, fold))]
                    if len(pairs) >= 64:
                        pairs[:] = [add_up(pairs)]
        for fold, pairs in held.items():
            keys, n = add_up(pairs) if pairs else (np.zeros(0, np.int64),) * 2
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_pydict({"fold": pa.array([fold] * len(keys[part]), pa.int32()), "key": pa.array(keys[part], pa.int64()), "n": pa.array(n[part], pa.int64())})

    return chunks.select("payload").mapInArrow(count, schema).groupBy("fold", "key").agg(F.sum("n").alias("n"))


def train(counts: DataFrame) -> tuple[DataFrame, dict[int, list[tuple[float, float, float]]]]:
    """Records (model, key and _FIELDS) of the models, and the discounts of each by order."""
    models = F.array(F.lit(_ALL), *[F.when(F.col("fold") != k, F.lit(k)) for k in range(FOLDS)])
    spread = counts.select(F.explode(F.filter(models, lambda m: m.isNotNull())).alias("model"), "key", "n")
    by_order = [spread.groupBy("model", "key").agg(F.sum("n").alias("n"))]
    for order in range(ORDER - 1, 0, -1):  # below the highest order, counts are numbers of distinct left neighbours
        if order >= ORDER - 2:
            by_order[0] = cut(by_order[0], "ngrams")  # lower orders are few and quickly counted again
        shorter = F.col("key").bitwiseAND((1 << SYMBOL * order) - 1).alias("key")
        by_order.insert(0, by_order[0].groupBy("model", shorter).agg(F.count(F.lit(1)).alias("n")))
    cuts: dict[int, list] = {}
    parts = []
    of = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    how_often = [grams.groupBy("model").agg(*of).withColumn("o", F.lit(order)) for order, grams in enumerate(by_order, 1)]
    for r in sorted(functools.reduce(DataFrame.unionByName, how_often).collect(), key=lambda r: r.o):  # one row a model and order
        cuts.setdefault(r.model, []).append(discounts([r.n1, r.n2, r.n3, r.n4]))
    for order, grams in enumerate(by_order, 1):
        zero = F.lit(0).cast("long")
        parts.append(grams.select("model", F.col("key").bitwiseOR(F.lit(order << _TAG)).alias("key"), "n", *[zero.alias(f) for f in _FIELDS[1:]]))
        context = F.shiftright("key", SYMBOL).bitwiseOR(F.lit((order - 1) << _TAG)).alias("key")
        how = [F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if(F.col("n") > 2).alias("more")]
        parts.append(grams.groupBy("model", context).agg(*how).select("model", "key", zero.alias("n"), *_FIELDS[1:]))
    records = cut(functools.reduce(DataFrame.unionByName, parts).groupBy("model", "key").agg(*[F.sum(f).alias(f) for f in _FIELDS]), "records")
    for grams in by_order:
        forget(grams)
    return records, cuts


def _shard(keys, shards: int):
    """Of an array of record keys, or of a column."""
    return keys % 1_000_003 % shards


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of record keys, shard by shard and in order within each, and the shards' edges among them."""
    where = _shard(keys, shards).astype(np.min_scalar_type(shards - 1))
    return np.argsort(where, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(where, minlength=shards))])


def _shrink(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, compressed."""
    return np.int64(len(keys)).tobytes() + pa.compress(np.diff(keys, prepend=0).astype("<i8").reshape(-1, 1).view(np.uint8).T.tobytes(), "zstd", asbytes=True)


def _grow(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def answers(chunks: DataFrame, at: int, records: DataFrame, shards: int, models: tuple[int, ...] = (_ALL, *range(FOLDS))) -> DataFrame:
    """chunk, model, shard, found (a bit for each key asked), records (of those found): what each chunk needs of each model. The
    models of folds are asked for the trusted documents of their fold."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for model in models:
                    wanted = asked(_distinct(*_texts(payload, at, model)))
                    places, ends = _by_shard(wanted, shards)
                    rows += [(s, chunk, model, _shrink(wanted[places[ends[s] : ends[s + 1]]])) for s in np.flatnonzero(np.diff(ends)).tolist()]
                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "chunk", "model", "keys"), r, strict=True)) for r in rows], schema=sent)

    def answer(pdf, known):
        by_model = {}
        for model, part in known.groupby("model"):
            part = part.sort_values("key")
            by_model[model] = part["key"].to_numpy(), part[list(_FIELDS)].to_numpy(np.int64)
        out = []
        for chunk, model, raw in zip(pdf["chunk"], pdf["model"], pdf["keys"], strict=True):
            keys = _grow(raw)
            has, table = by_model.get(model, (np.zeros(0, np.int64), np.zeros((0, len(_FIELDS)), np.int64)))
            where = np.minimum(np.searchsorted(has, keys), max(len(has) - 1, 0))
            found = has[where] == keys if len(has) else np.zeros(len(keys), bool)
            body = np.ascontiguousarray(table[where[found]].T) if len(has) else np.zeros((len(_FIELDS), 0), np.int64)
            out.append((chunk, model, pdf["shard"].iloc[0], np.packbits(found).tobytes(), pa.compress(body.tobytes(), "zstd", asbytes=True)))
        return pd.DataFrame(out, columns=["chunk", "model", "shard", "found", "records"])

    sent = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("model", pa.int32()), ("keys", pa.binary())])
    probes = chunks.select("chunk", "payload").mapInArrow(ask, "shard int, chunk long, model int, keys binary")
    dealt = records.where(F.col("model").isin(*models)).withColumn("shard", _shard(F.col("key"), shards).cast("int"))
    return probes.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(answer, "chunk long, model int, shard int, found binary, records binary")


def scored(chunks: DataFrame, at: int, fields: list[StructField], given: DataFrame, cuts: dict, shards: int, held_out: bool, names: tuple[str, str]) -> DataFrame:
    """The documents of the chunks with the sum of their negative log probabilities and their bytes: all documents by the model of
    all folds, or the trusted ones by the model that leaves out their fold (by that of all where the others have no text)."""
    schema = StructType([*fields, StructField(names[0], DoubleType()), StructField(names[1], LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, rows in zip(batch.column(0), batch.column(1), strict=True):
                table, by_model = _unpack(payload), {}
                for r in rows.as_py() or ():
                    by_model.setdefault(r["model"], {})[r["shard"]] = r["found"], r["records"]
                folds = table.column(table.num_columns - 1)
                for fold in range(FOLDS) if held_out else (_ALL,):
                    part = (table.filter(pa.compute.equal(folds, fold)) if held_out else table).combine_chunks()
                    model = fold if fold in cuts else _ALL
                    text = part.column(at)
                    raw, edges = _buffer(pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string()))
                    keys = _distinct(raw, edges)
                    # a model's answers are for the keys that were asked of it, in order of key within each shard
                    known = asked(keys if model == fold else _distinct(*_texts(payload, at, model)))
                    records, (places, ends) = np.zeros((len(known), len(_FIELDS)), np.int64), _by_shard(known, shards)
                    for shard, (found, body) in by_model.get(model, {}).items():
                        mine = places[ends[shard] : ends[shard + 1]]
                        mine = mine[np.unpackbits(np.frombuffer(found, np.uint8), count=len(mine)).astype(bool)]
                        body = pa.decompress(body, 8 * len(_FIELDS) * len(mine), "zstd", asbytes=True)
                        records[mine] = np.frombuffer(body, np.int64).reshape(len(_FIELDS), len(mine)).T
                    loss = losses(raw, edges, keys, log_probabilities(keys, known, records, cuts[model])) if len(keys) else np.zeros(len(edges) - 1)
                    out = part.drop_columns([part.column_names[-1]]).append_column(names[0], pa.array(loss, pa.float64())).append_column(names[1], pa.array(np.diff(edges), pa.int64()))
                    yield from out.to_batches()

    asked_of = F.col("model") >= 0 if held_out and len(cuts) > FOLDS else F.lit(True) if held_out else F.col("model") == _ALL
    by_chunk = given.where(asked_of).groupBy("chunk").agg(F.collect_list(F.struct("model", "shard", "found", "records")).alias("answers"))
    return chunks.join(by_chunk.hint("shuffle_hash"), "chunk", "left").select("payload", "answers").mapInArrow(score, schema)


def with_trust(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", name: str = "trusted", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with a column that says whether a label calls the document good and none calls it toxic. The ids are broadcast up to a
    checked number of rows and joined by id beyond it."""
    key, mark = fresh(docs, "labelled", "mark")
    good = labels.groupBy(F.col(id_col).alias(key)).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = cut(good.where((F.col("q") == 1) & (F.col("t") == 0)).select(key, F.lit(True).alias(mark)), "trusted-ids")
    joined = docs.join(F.broadcast(good) if good.count() <= broadcast_rows else good, docs[id_col] == good[key], "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(mark, F.lit(False)).alias(name))


def _language(lang):
    """Null apart from every text."""
    return F.when(lang.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), lang))


def _perplexity(loss, size, prior: float, mean: float):
    return F.exp((F.col(loss) + prior * mean) / (F.col(size) + prior))


def thresholds(trusted: DataFrame, prior: float, quantile: float, smoothing: float) -> tuple[DataFrame, float, float]:
    """Language and threshold for each language of the trusted documents (lang, loss, size); that of all of them, and their mean loss a byte."""
    total = trusted.agg(F.sum("loss"), F.sum("size")).first()
    mean = (total[0] or 0.0) / (total[1] or 1)
    rated = trusted.select("lang", _perplexity("loss", "size", prior, mean).alias("p"))
    at = F.percentile_approx("p", quantile, 10_000)
    every = rated.agg(at).first()[0]
    own = rated.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), at.alias("own"))
    drawn = every + F.col("n") / (F.col("n") + smoothing) * (F.col("own") - every)
    return cut(own.select("lang", drawn.alias("limit")), "thresholds"), float(every), float(mean)


def judge(
    docs: DataFrame, trusted_col: str = "trusted", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, smoothing: float = SMOOTHING,
    prior: float = PRIOR, chunk_bytes: int | None = None, shard_records: int = SHARD_RECORDS, names: tuple[str, str, str] = ("perplexity", "threshold", "keep"),
) -> DataFrame:
    """``docs`` with perplexity, threshold and keep (or ``names``). ``trusted_col`` marks the trusted documents."""
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    spark = docs.sparkSession
    text, parallel = F.col(text_col).cast("string"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunk_bytes = chunk_bytes or min(CHUNK_BYTES, max(_LEAST_CHUNK, size // (4 * parallel)))  # a small input still makes work for all cores
    fold = F.pmod(F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 6), 16, 10).cast("int"), F.lit(FOLDS))
    at, loss, length, lang, limit = docs.columns.index(text_col), *fresh(docs, "loss", "size", "language", "limit")
    chunks = chunked(docs, text_col, F.when(F.col(trusted_col), fold).otherwise(_ALL).cast("int"), chunk_bytes, max(parallel, size // BUCKET_BYTES))
    counts = cut(count_ngrams(chunks, at), "ngram-counts")
    if counts.isEmpty():
        null = F.lit(None).cast("double")
        return docs.withColumns({names[0]: null, names[1]: null, names[2]: F.lit(True)})
    tidy(spark)  # shuffle files of steps that are done would stay beside the next ones'
    records, cuts = train(counts)
    forget(counts)
    tidy(spark)
    shards = max(parallel, int(records.count() // shard_records), int(size // 40 // SHARD_KEYS)) + 1
    apart = len(cuts) > FOLDS  # models of folds answer first and their answers go, unless the model of all must stand in for one
    given = cut(answers(chunks, at, records, shards, tuple(range(FOLDS)) if apart else (_ALL, *range(FOLDS))), "answers")
    tidy(spark)
    known = scored(chunks, at, docs.schema.fields, given, cuts, shards, True, (loss, length))
    known = cut(known.select(_language(F.col(lang_col).cast("string")).alias("lang"), F.col(loss).alias("loss"), F.col(length).alias("size")), "trusted-scores")
    limits, every, mean = thresholds(known, prior, quantile, smoothing)
    if apart:
        forget(given)
        tidy(spark)
        given = cut(answers(chunks, at, records, shards, (_ALL,)), "answers")
    forget(records)
    tidy(spark)
    limits = limits.select(F.col("lang").alias(lang), F.col("limit").alias(limit))
    judged = scored(chunks, at, docs.schema.fields, given, cuts, shards, False, (loss, length)).withColumn(lang, _language(F.col(lang_col).cast("string")))
    judged = judged.join(F.broadcast(limits) if limits.count() <= 100_000 else limits, lang, "left")
    found, most = _perplexity(loss, length, prior, mean), F.coalesce(F.col(limit), F.lit(every))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(names[0]), most.alias(names[1]), ((F.col(length) == 0) | (found <= most)).alias(names[2]))


def oracle(quantile: float = QUANTILE, smoothing: float = SMOOTHING, prior: float = PRIOR) -> str:
    """The query in DuckDB SQL: n-grams are strings of hexadecimal digits, a pad is two dots."""
    steps = [f"c{ORDER} AS (SELECT m, g, sum(n) AS n FROM k JOIN models ON m = -1 OR f <> m WHERE f >= 0 GROUP BY ALL)"]
    for o in range(ORDER - 1, 0, -1):
        steps.append(f"c{o} AS (SELECT m, right(g, {2 * o}) AS g, count(*) AS n FROM c{o + 1} GROUP BY ALL)")
    cut_ = lambda x, most: f"least(greatest({x}, 0.01), {most})"
    for o in range(1, ORDER + 1):
        y = "CAST(n1 AS DOUBLE) / (n1 + 2 * n2)"
        steps.append(f"h{o} AS (SELECT m, " + ", ".join(f"CAST(count(*) FILTER (WHERE n = {i}) AS DOUBLE) AS n{i}" for i in (1, 2, 3, 4)) + f" FROM c{o} GROUP BY m)")
        ds = [cut_(f"1 - 2 * y * n2 / n1", 0.99), cut_("2 - 3 * y * n3 / n2", 1.99), f"CASE WHEN n3 > 0 THEN {cut_('3 - 4 * y * n4 / n3', 2.99)} ELSE 1.0 END"]
        steps.append(f"d{o} AS (SELECT m, " + ", ".join(f"CASE WHEN n1 > 0 AND n2 > 0 THEN {d} ELSE 0.5 END AS d{i}" for i, d in enumerate(ds, 1)) + f" FROM (SELECT *, {y} AS y FROM h{o}))")
        ctx = f"left(g, {2 * (o - 1)})"
        steps.append(f"t{o} AS (SELECT m, {ctx} AS x, CAST(sum(n) AS DOUBLE) AS t, count(*) FILTER (WHERE n = 1) AS a, count(*) FILTER (WHERE n = 2) AS b, count(*) FILTER (WHERE n > 2) AS c FROM c{o} GROUP BY ALL)")
    steps.append(f"p0 AS (SELECT DISTINCT m, g, CAST(1.0 / 256 AS DOUBLE) AS p FROM k JOIN models ON m = -1 OR f = m)")
    for o in range(1, ORDER + 1):
        own = f"CASE WHEN c{o}.n IS NULL THEN 0 ELSE c{o}.n - CASE c{o}.n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END END"
        steps.append(
            f"p{o} AS (SELECT p.m, p.g, CASE WHEN t IS NULL THEN p ELSE ({own} + (d1 * a + d2 * b + d3 * c) * p) / t END AS p FROM p{o - 1} p JOIN d{o} USING (m) "
            f"LEFT JOIN t{o} ON t{o}.m = p.m AND x = left(right(p.g, {2 * o}), {2 * (o - 1)}) LEFT JOIN c{o} ON c{o}.m = p.m AND c{o}.g = right(p.g, {2 * o}))"
        )
    last = f"p{ORDER}"
    loss = lambda m: f"SELECT r, -sum(n * ln(p)) AS loss FROM k JOIN {last} ON {last}.g = k.g AND m = {m} GROUP BY r"
    return f"""
WITH good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(coalesce(toxic, 0)) = 0),
e AS (SELECT row_number() OVER () AS r, doc_id, lang, strlen(coalesce(text, '')) AS size, hex(encode(coalesce(text, ''))) AS h,
  CASE WHEN doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL) THEN CAST(('0x' || md5(coalesce(text, ''))[1:6]) AS BIGINT) % {FOLDS} ELSE -1 END AS f FROM documents),
w AS (SELECT r, f, repeat('.', {2 * (ORDER - 1)}) || h AS s, unnest(range(0, size)) AS i FROM e),
k AS (SELECT r, f, substr(s, 2 * i + 1, {2 * ORDER}) AS g, count(*) AS n FROM w GROUP BY ALL),
models(m) AS (VALUES (-1){''.join(f', ({f})' for f in range(FOLDS))}),
{', '.join(steps)},
held AS (SELECT lang, size, coalesce(loss, 0) AS loss FROM e LEFT JOIN ({loss("f")}) USING (r) WHERE f >= 0),
mean AS (SELECT sum(loss) / sum(size) AS mean FROM held),
rated AS (SELECT lang, exp((loss + {prior} * mean) / (size + {prior})) AS p FROM held, mean),
every AS (SELECT quantile_disc(p, {quantile}) AS every FROM rated),
own AS (SELECT lang, any_value(every) + count(*) / (count(*) + CAST({smoothing} AS DOUBLE)) * (quantile_disc(p, {quantile}) - any_value(every)) AS own FROM rated, every GROUP BY lang),
j AS (SELECT doc_id, e.lang, size, exp((coalesce(loss, 0) + {prior} * mean) / (size + {prior})) AS p, coalesce(own, every) AS t
  FROM e LEFT JOIN ({loss(-1)}) USING (r) CROSS JOIN mean CROSS JOIN every LEFT JOIN own ON own.lang IS NOT DISTINCT FROM e.lang)
SELECT doc_id, lang, round(p, 6) AS perplexity, round(t, 6) AS threshold, size = 0 OR p <= t AS keep FROM j"""
