"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage works on all that the one before kept; its result is written as
Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trafficlens.llm.best_fit import pack_documents
from trafficlens.llm.common import prepare, table
from trafficlens.llm.decontaminate import remove_contamination
from trafficlens.llm.minhash import drop_near_duplicates
from trafficlens.llm.quality_rules import filter_quality
from trafficlens.llm.secret_scan import redact_secrets
from trafficlens.session import shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(spark, docs, sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contamination(spark, docs, sf_dir)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: The learned verdicts and the packing have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; the packing of what they keep."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
