"""The corpus pipeline: quality rules, near-dedup, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of `documents`; the last returns the packed
pieces. Stages are written as Parquet and read again between. There is no SQL for the whole (ORACLE_SQL is None): the tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common, mixing, near, packing, personal, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's rate reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return near.deduplicated(docs, 5, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return personal.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that a document's words are taken."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.queries import table

    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
