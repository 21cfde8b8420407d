"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

Each stage works on all rows its predecessor kept. All but the last return the columns of documents; where a stage
changes a text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolith.llm import decontamination, jaccard_join, pieces, pii, quality_rules
from fotolith.llm.scratch import Scratch


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; so do documents that are mostly benchmark text."""
    return _recounted(decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes marks."""
    return _recounted(pii.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of pieces beside the columns of documents."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", private_data),
    ("sentencepiece", tokens),
]

#: SQL can't express the fourth and fifth stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}_{name}")
        scratch.clear(keep=[f"{k}_{name}"])
    return docs
