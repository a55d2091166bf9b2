"""From raw documents to a sharded training mix: each stage calls one operator and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import stages
from strandlake.scratch import new_path

STAGES = [
    ("quality classifier", stages.quality),
    ("MinHash near-dedup", stages.near_dedup),
    ("benchmark decontamination", stages.decontaminate),
    ("mixing sources to target weights", stages.mix),
    ("sharding", stages.shard),
]

#: SQL can't express the classifier; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
