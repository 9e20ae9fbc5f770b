"""A training-data pipeline over `documents`: quality rules, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next stage's
docs; all but the last return the columns of documents.

Cases: texts that are null or empty fail the quality rules, so no later stage meets them in run(); taken alone, the later
stages keep them (packing as one piece, the end id). Null ids and other null columns are kept as they are; a repeated row
is one near-duplicate of itself; very long texts are treated whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import decontaminate, packing, pii, quality, simhash
from spanlake.llm.common import shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the rules and the line labeller keep."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with the benchmark; the passages are cut out of the original text."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pii.replace_column(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids."""
    return packing.pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark passages", benchmark_passages), ("personal data", personal_data), ("packing", packed)]

#: The stages run models and hashes that SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two of them is written below the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = shared_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{i}")
            docs = spark.read.parquet(f"{at}/{i}")
    return docs
