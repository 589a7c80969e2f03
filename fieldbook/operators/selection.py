"""Places in an order of all rows, without one task or heap that has them all.

Rows are dealt to ranges of the order and written once to the shared folder; the numbers of rows of the ranges, which are
as many as there are shuffle partitions, tell where each range begins.  A page then sorts the ranges it lies in and no
others, and numbering sorts each range by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from fieldbook.sources.published import shared_folder


def _ranged(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """rows with `_range`, and (range, rows in it) in order."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(path)
    schema = dealt.schema.add("_range", "int") if "_range" not in dealt.columns else dealt.schema
    stored = spark.read.schema(schema).parquet(path)
    return stored, sorted((r[0], r[1]) for r in stored.groupBy("_range").count().collect())


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The rows at places offset, offset + 1 ... of the order, `limit` at most.  The order decides between any two rows."""
    stored, counts = _ranged(rows, order)
    begins, some, before = 0, [], None
    for part, n in counts:
        if begins < offset + limit and begins + n > offset:
            some.append(part)
            before = begins if before is None else before
        begins += n
    found = stored.where(F.col("_range").isin(some) if some else F.lit(False))
    return found.orderBy(*order).offset(offset - (before or 0)).limit(limit).drop("_range")


def nth(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The row at place k modulo the number of rows; none of none."""
    n = rows.count()
    return page(rows, order, k % n, 1) if n else rows.limit(0)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`: their place in the order, from 1."""
    stored, counts = _ranged(rows, order)
    begins, starts = 0, []
    for part, n in counts:
        starts.append((part, begins))
        begins += n
    bases = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _base long"))  # a row per shuffle partition
    placed = stored.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(bases, "_range")
    return placed.withColumn(name, F.col("_base") + F.col("_in")).drop("_range", "_base", "_in")
