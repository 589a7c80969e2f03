"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


#: Folder of the public tokenizers' files; None for the installed package of that name.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Bytes of an Arrow batch handed to a Python worker; Spark's own default of 64 MB is a worker's whole memory here.
BATCH_BYTES = 8_000_000


#: What tasks keep in their worker for later ones, as tokenizers; a task of another module empties them.
CACHES: list[dict] = []
#: Batches after which a task gives back memory that it has let go.
GIVE_BACK = 8
_last = [""]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Returns to the system what this process no longer uses: a worker lives as long as the session and serves all operators."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def frugal(task: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """task(batches) in a worker that holds no other operator's memory, and none of its own that is free."""
    if _last[0] != task.__module__:
        _last[0] = task.__module__
        for cache in CACHES:
            cache.clear()
        give_back()
    try:
        for i, batch in enumerate(task(batches)):
            yield batch
            if i % GIVE_BACK == GIVE_BACK - 1:
                give_back()
    finally:
        give_back()


def in_batches(df: DataFrame, task: Callable, schema) -> DataFrame:
    """df.mapInArrow(task, schema), with batches bounded in bytes as well as rows (a smaller setting of the session holds), run by `frugal`."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(lambda batches: frugal(task, batches), schema)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, named by the cluster; only where everything runs in one process may it be a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/fieldbook-checkpoints"


#: Spark deletes the shuffle files of a query planned under this setting when the query ends; otherwise they stay until
#: the driver happens to collect garbage, and a job of many queries holds the files of all of them.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(df: DataFrame) -> DataFrame:
    """df as a query of its own, which leaves no shuffle files behind; for one action only, as a second would shuffle again."""
    conf = df.sparkSession.conf
    now = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        return df.select("*")
    finally:
        conf.set(RELEASE, now) if now else conf.unset(RELEASE)


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder, so that later stages neither recompute nor lose it; its shuffle files go."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return released(df).checkpoint(eager=True)


def bitmap(ids: DataFrame, columns: list[str], bits: int, spot: Column | None = None) -> np.ndarray:
    """Bits of the hashed ids (or of `spot`, their place): bits / 8 bytes whatever their number, so it may be broadcast."""
    spot = (F.pmod(F.xxhash64(*columns), F.lit(bits)) if spot is None else spot) + 1  # buckets and positions begin at 1
    spots = ids.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
    rows = released(spots.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))).collect()
    out = np.zeros(bits // 8 + 8192, dtype=np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] |= np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def marked(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return ((bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).astype(bool)


#: The parts into which `beside` deals the rows of a key.
PARTS = 1024


def beside(df: DataFrame, keys: list[str], spread: list[str], value: Column, merge: Callable, name: str) -> DataFrame:
    """Adds `name`, an aggregate over all rows with the same keys, to each row, and never gathers a key's rows in one task.

    A key's rows are dealt by the hash of `spread` into PARTS parts; `value` aggregates a part and `merge` the values of
    a key's parts, of which there are PARTS at most, and rows meet the result by key and part.  The keys are not null.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)))
    parts = dealt.groupBy(*keys, "_part").agg(value.alias("_value"))
    whole = parts.select(*keys, "_part", merge("_value").over(Window.partitionBy(*keys)).alias(name))
    return dealt.join(whole, [*keys, "_part"]).drop("_part")


def before(df: DataFrame, group: list[str], order: list[str], value: str, name: str, chunk: Column) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same group that come earlier by (chunk, order).

    Two levels: sums per (group, chunk) are scanned per group, rows per (group, chunk), so that a hot group is
    spread over its chunks and no task holds all its rows.  The columns of `group` and `chunk` are not null.
    """
    df = df.withColumn("_chunk", chunk)
    sums = df.groupBy(*group, "_chunk").agg(F.sum(value).alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_c"),
                       F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    # plain equality keeps the window's partitioning, so the rows are shuffled once
    match = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)] + [F.col("_chunk") == F.col("_c")]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return (rows.join(sums, condition).withColumn(name, F.col("_base") + F.col("_in"))
            .drop("_chunk", "_c", "_base", "_in", *[f"_g{i}" for i in range(len(group))]))
