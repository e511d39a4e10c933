"""The corpus pipeline: documents through five of the text operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from warpwise.llm import stages
from warpwise.runtime import materialise

STAGES = stages.STAGES
ORACLE_SQL = None  # trained models and fingerprints are beyond SQL; tests compare with plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
