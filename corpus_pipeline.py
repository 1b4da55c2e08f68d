"""A corpus from raw documents to shards: five stages, each over all that its predecessor kept.

Each stage is (spark, docs, sf_dir) -> DataFrame and is written and read again before the next one. All but the last
return the columns of `documents`. Rejected are: documents that the quality classifier scores below its threshold; all
but one of each class of near-duplicates; documents with a benchmark window; toxic and junk documents beyond their weights.
Every stage judges rows by their own texts, so rows that repeat an id don't share a verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, jaccard_join, mixing, sharding, subword_quality
from tidegauge.llm.common import materialize

#: Target weights of the mixture's tokens.
WEIGHTS = {"clean": 0.94, "toxic": 0.05, "junk": 0.01}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return subword_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.thin(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.interleave(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing to target weights", mixture), ("sharding", shards)]

#: Learnt scores and probabilistic buckets are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
