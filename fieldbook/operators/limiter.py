"""Rate limiting over a log of attempts: a sliding window of accepted attempts.

Whether an attempt is accepted depends on earlier decisions, so it is no window function.  But a pause as long as the
window forgets all of them: a key's attempts fall into runs between such pauses, which are decided independently.  Pauses
are found between spans of the window's length, of which only the first and the last time are looked at, so no task reads
all attempts of a key for that.  Each run is read in order as a stream of Arrow batches with the accepted times of the
window as its only state (as many as the limit); it is one task's work, by its meaning.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def runs(attempts: DataFrame, key: str, micros: str, width: int) -> DataFrame:
    """attempts with `_run`: within a key, the number of pauses of at least `width` microseconds up to the attempt."""
    spanned = attempts.withColumn("_span", F.floor(F.col(micros) / width))
    spans = spanned.groupBy(key, "_span").agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
    in_order = Window.partitionBy(key).orderBy("_span")
    pause = F.coalesce(F.col("_first") - F.lag("_last").over(in_order) >= width, F.lit(True))
    numbered = spans.withColumn("_pause", pause.cast("long")).withColumn("_run", F.sum("_pause").over(in_order))
    numbered = numbered.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), "_run")
    return spanned.join(numbered, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_of"))).drop("_key", "_of", "_span")


def sliding(attempts: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """attempts with `accepted`: fewer than `most` attempts were accepted in the `seconds` before it.

    Attempts at one time are taken in the given order; those without a time are left out, and those without a key are one key's.
    """
    parts = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = seconds * 1_000_000
    names = attempts.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = task
        live: deque[int] = deque()
        for batch in batches:
            accepted = []
            for k, run, t in zip(batch.column(key).to_pylist(), batch.column("_run").to_pylist(), batch.column("_micros").to_pylist()):
                if (k, run) != here:
                    here, live = (k, run), deque()
                while live and live[0] <= t - width:
                    live.popleft()
                accepted.append(len(live) < most)
                if accepted[-1]:
                    live.append(t)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(accepted, type=pa.bool_())], names=[*names, "accepted"])

    timed = attempts.where(F.col(at).isNotNull()).withColumn("_micros", F.unix_micros(F.col(at).cast("timestamp")))
    ordered = runs(timed, key, "_micros", width).repartition(parts, key, "_run").sortWithinPartitions(key, "_run", "_micros", order)
    return ordered.mapInArrow(task, attempts.schema.add("accepted", "boolean"))
