"""Operators as stages over a table like ``documents``: what is decided takes effect, columns stay.

Rows travel as one struct beside the columns a stage adds, so no column of theirs can clash with a working name; columns
that an operator doesn't read are passed on as they are. Each stage has the defined results of its operator:

========== ======================================================================================================
null text  kept by quality; one of the empty texts in near-dedup; unchanged by redaction; never taken by the mix
           (size 0); the closing id alone in packing
empty text like a null text, but a text of its own in near-dedup
null id    kept last among like texts; otherwise a document like any other
ties       repeated rows are judged alike by quality and redaction, one stays in near-dedup, each is a document of
           its own in the mix and in packing
long text  judged, redacted, mixed and packed as a whole
empty table gives an empty table with the same columns
========== ======================================================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import mixing, packing, pii, quality, simhash
from quirelake.session import cut, fresh


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the quality classifier, trained on all trusted ones, keeps."""
    trusted, *names = fresh(docs, "trusted", "perplexity", "threshold", "keep")
    judged = quality.judge(quality.with_trust(docs, labels, name=trusted), trusted, names=tuple(names))
    return judged.where(names[-1]).select(*docs.columns)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def hide_personal(docs: DataFrame) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it: a row for each pass, with the words of that pass.

    A pass over all words has the text as it is, a pass over some has these words joined by spaces. The choice follows
    the rows' contents, not their places, so a rerun over the same rows agrees.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id", "source")], F.lit(0).alias(fresh(docs, "none")[0])).alias("rest")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), rest)
    rows = cut(rows, "mix-documents")
    chosen = mixing.mix_documents(rows, row_col="row", ties=("all",)).where(F.col("taken") > 0).select("row", "size", "segments")
    met = rows.drop("all").join(chosen.hint("shuffle_hash"), "row").withColumn("n", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("segments", lambda s: s["times"])))))
    mine = F.filter("segments", lambda s: s["times"] >= F.col("n"))
    taken = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    piece = lambda w: F.array_join(F.flatten(F.transform(mine, lambda s: F.slice(w, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), " ")
    some = F.element_at(F.transform(F.array(words), piece), 1)  # the words are split once, however many pieces take some
    out = met.select(F.when(taken == F.col("size"), F.col("text")).otherwise(some).alias("passed"), "doc_id", "source", "rest")
    new = {"text": F.col("passed"), "n_chars": F.length("passed").cast("long"), "doc_id": F.col("doc_id"), "source": F.col("source")}
    return out.select(*[new[c].alias(c) if c in new else F.col("rest").getField(c).alias(c) for c in docs.columns])


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids."""
    return packing.pack_documents(docs, tokenizer_path).withColumnRenamed("raw", "ids")
