"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture, tokens; each stage is one operator of framelake.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, mixing, quality, secrets, simhash
from framelake.llm.common import documents, ensure_checkpoint_dir, reach_workers

#: Its rows are those of Python tokenizers and of XXH64 fingerprints: tests hold it against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    reach_workers(spark)
    return quality.quality_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    reach_workers(spark)
    return simhash.near_dedup_stage(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced by a mark."""
    reach_workers(spark)
    return secrets.secrets_stage(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target asks for."""
    reach_workers(spark)
    return mixing.mixing_stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the place of the text."""
    reach_workers(spark)
    return bpe.encode_stage(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again; what a stage has read goes once its own rows are written."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
