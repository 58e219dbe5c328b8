"""The corpus pipeline: STAGES applied one after the other to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondage.llm import pipeline
from sondage.llm.common import prepare, table, written

STAGES = pipeline.STAGES
ORACLE_SQL = None  # hashes, learned rules and a tokenizer take part; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
