"""Corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing and packing.

`STAGES` lists the stages in order.  Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`.  `run` applies them to the table `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import pipeline

STAGES = pipeline.STAGES

#: Line dedup needs edit distances between all lines and language ID learned vectors: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
