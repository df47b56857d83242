"""From raw documents to packed sequences: quality, near duplicates, personal data, mix, packing.

Each stage reads what the one before it wrote. SQL can't express the stages (a language model,
64-bit hashes, a tokenizer), so they are tested against plain versions of their operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import stages
from quirelake.session import cut, forget, scratch, ship, table, tidy

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return stages.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    ship(spark)
    return stages.keep_distinct(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    return stages.hide_personal(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    ship(spark)
    return stages.mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tidy(spark)
    import public_tokenizers

    ship(spark)
    return stages.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's working tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(cut(stage(spark, before, sf_dir), name.replace(" ", "-")))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
