"""Costly work on a text or a line is done once, and by all tasks."""

import json

from fieldbook.functions import text
from fieldbook.operators import search, validation
from fieldbook.plans import workflow
from fieldbook.plans.imports import RECORD
from fieldbook.sources.tables import spread
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_of_many_splits_is_dealt_out(spark, tmp_path):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/t")
    names = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        read = spark.read.parquet(f"{tmp_path}/t")
        assert read.rdd.getNumPartitions() >= 8
        dealt = spread(read).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) >= 8 and max(r[1] for r in dealt) < 1000
        assert spread(read).agg(F.sum("id")).first()[0] == sum(range(4000))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(json.dumps({"name": "a"}),), ("[1]",), (None,)], "line string")
    assert plan(lines.select(validation.errors(F.col("line"), RECORD))).count("parseJson") == 1


def test_a_text_is_cleaned_once(spark):
    assert plan(workflow.cleanup_diff(spark, SF)).count("【\\d") == 1


def test_numbers_words_and_blanks(spark):
    rows = spark.createDataFrame([("main 602-555-0100 or 1 (888) HELPNOW; 602.555.0100, 911",), ("Größe_12 a b\u0085c",), ("　 x ﻿\n",), (" \n",), (None,)], "t string")
    got = rows.select(text.phones(F.col("t")).alias("p"), search.tokens(F.col("t")).alias("w"), text.strip(F.col("t")).alias("s"), text.squash(F.col("t")).alias("q")).collect()
    assert [r["p"] for r in got[:4]] == [["6025550100", "8884357669"], ["4777312222"], [], []] and got[4]["p"] is None
    assert got[1]["w"] == ["gr", "e", "12", "a", "b", "c"] and [r["s"] for r in got[2:]] == ["x", "", None] and [r["q"] for r in got[1:]] == ["Größe_12 a b\u0085c", "x", None, None]
