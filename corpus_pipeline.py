"""A corpus pipeline: language, near duplicates, mixing, packing. Each stage is one operator of crossweave.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossweave.llm import langid, mixing, ngram_join, packing
from crossweave.llm.shared import save


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language (no letters, no text) go."""
    return langid.known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id. Rows that repeat an id with another text are other documents."""
    return ngram_join.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs, tuple(docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Trigram vectors, signature joins and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
