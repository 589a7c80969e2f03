"""Streams over the tables dealt into deliveries: at-least-once events into a keyed snapshot, and the rate limiter."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldbook.plans import workflow  # noqa: F401  its SQL comes first
from fieldbook.plans.registry import SQL, query
from fieldbook.sources.published import shared_folder
from fieldbook.sources.tables import table
from fieldbook.streaming import events

#: Batches that the deliveries are dealt into; one of them comes twice under its number, and one again under a new one.
BATCHES = 4


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_linestatus").alias("status"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("at"))


@query("""with d as (select l_orderkey || '-' || l_linenumber as event_id, floor(round(l_extendedprice * 100))::bigint as cents, l_linestatus as status, (l_shipdate, l_partkey, l_suppkey) as moment from lineitem)
select event_id, arg_min(cents, moment) as cents, arg_max(status, moment) as status from d group by event_id""")
def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot after all deliveries in batches, some of which come again: each event's first amount and last status.

    Batches come in no order of time.  The snapshot lies in the shared folder until the session ends.
    """
    rows = events.delivered(_deliveries(spark, sf_dir))
    batch = F.pmod(F.xxhash64("first_at"), F.lit(BATCHES))
    store = events.event_store(spark, shared_folder(spark), 16)
    for number, part in ((0, 3), (1, 1), (1, 1), (2, 0), (3, 2), (4, 1)):
        store.apply(rows.where(batch == part), number)
    return store.read().select("event_id", "cents", "status")


@query(SQL["rate_limit"])
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rate_limit as a stream: attempts come shuffled in four micro-batches, each up to a batch late; two in six hours per user.

    A micro-batch is what has come since the last run of the stream, in as many files as there are tasks.  A last row,
    later than all others by more than what may be late, moves the watermark past them; it is never decided.
    """
    attempts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")).where("ts is not null and key is not null")
    first, last = attempts.agg(F.min("ts"), F.max("ts")).first()
    path = shared_folder(spark)
    if first is not None:
        width = int((last - first).total_seconds() / (BATCHES - 1)) + 1
        turn = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lit(first))) / width) + F.pmod(F.xxhash64("id"), F.lit(2))
        end = spark.createDataFrame([(-1, -1, last + timedelta(seconds=3 * width + 2 * 6 * 3600))], attempts.schema)
        for come in [*[attempts.where(turn == k).sortWithinPartitions(F.xxhash64("id")) for k in range(BATCHES)], end.coalesce(1)]:
            come.write.mode("append").parquet(f"{path}/in")
            source = spark.readStream.schema(attempts.schema).parquet(f"{path}/in")
            with events.stateful(spark):
                running = (events.limited(source, 6 * 3600, 2, f"{width + 1} seconds").writeStream.format("parquet").option("path", f"{path}/out")
                           .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
            running.awaitTermination()
    done = spark.read.schema("id long, key long, accepted boolean").parquet(f"{path}/out") if first is not None else attempts.selectExpr("id", "key", "true as accepted")
    return done.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "accepted")
