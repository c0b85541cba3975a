"""Corpus pipeline: documents to tokens in five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tvloom.llm import stages
from tvloom.llm.shared import written

STAGES = [
    ("language_id", stages.identify_language),
    ("line_dedup", stages.deduplicate_lines),
    ("near_dedup", stages.drop_near_copies),
    ("decontamination", stages.decontaminate),
    ("bpe", stages.tokenize),
]

#: Kernels, sketches and merges aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
