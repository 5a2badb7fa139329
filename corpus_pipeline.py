"""The corpus pipeline: from raw ``documents`` to packed training sequences.

Stages, each over all that the one before kept: language ID (rejected documents
go), quality (low ones go), SimHash near duplicates (one of each group stays),
secrets (values are masked in the text), packing. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from razao.llm import language_id, packing, quality_neighbours, secret_scan, simhash
from razao.llm.common import table, written
from razao.llm.queries import remainder, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is taken for one of the languages that the documents name."""
    return language_id.keep_accepted(docs, language_id.learn(docs, remainder(4) != 2))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours don't vote down."""
    space = quality_neighbours.learn(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality_neighbours.keep_good(docs, space)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group within two bits over 3-word shingles."""
    return simhash.keep_first(docs, words=3, max_bits=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secret values masked and ``n_chars`` counted anew."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", pack)]

#: No SQL can express the language, quality and packing stages; tests/llm holds the pipeline against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
