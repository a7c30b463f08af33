"""A corpus pipeline: language identification, exact and near deduplication, packing.

Each stage takes (spark, docs, sf_dir), with docs what its predecessor kept, read again from Parquet. All but the
last return rows of ``documents`` with its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rayframe.llm import exact_dedup, langid, packing, similar
from rayframe.llm.common import keep


def _small_batches(spark: SparkSession) -> None:
    """Documents are long: batches to Python workers go by bytes, so that an executor holds little of them at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those without a letter go."""
    _small_batches(spark)
    return langid.identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by SimHash as sharing 0.8 of their runs of five words, the one with the smallest id."""
    _small_batches(spark)
    return similar.distinct_documents(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, placed in training sequences."""
    _small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), batch_bytes=4 << 20).drop("n_loss")


STAGES = [("language", language), ("exact", exact), ("near", near), ("pack", pack)]

#: Near copies, language models and token ids are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
