"""A corpus pipeline over ``documents``: quality, near-duplicates, decontamination, mixing and sharding.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and columns of any other name; what it makes of them is stated by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeloom.llm import mixing, neardup, quality, sharding, winnowing
from gaugeloom.llm.shared import saved, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression doesn't reject; null and empty texts are judged by the thresholds alone."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each class of near-duplicates; texts without words are classes of their own."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item; texts without words stay."""
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words stay once, a null source is a source."""
    return mixing.take_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document; a null doc_id is a key, repeated rows get a slot each."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hash sampling and a trained model are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet in the shared folder and read again by the next."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
