"""The training-data pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage works on all rows that the one before kept, takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from billforge.llm import common, op2_quality, op3_decontaminate, op4_simhash, op7_sharding, op9_mixing
from billforge.workers import share_path

STAGES = [
    ("quality_rules", op2_quality.stage),
    ("simhash_dedup", op4_simhash.stage),
    ("decontamination", op3_decontaminate.stage),
    ("source_mixing", op9_mixing.stage),
    ("sharding", op7_sharding.stage),
]

#: SQL can't express the stages (XXH64, iteration); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_path(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
