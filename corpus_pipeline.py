"""Corpus preparation in stages; each takes (spark, docs, sf_dir) and returns the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafsight.llm.common import settle
from leafsight.llm.stages import decontaminated, mixed, near_deduplicated, non_toxic, sharded

STAGES = [
    ("toxicity", non_toxic),
    ("near_dedup", near_deduplicated),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: Training a classifier and min-wise sketches are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
