"""An incrementally merged snapshot: rows by key, in buckets by the key's hash, of which a batch rewrites only those it touches.

`fold` takes rows of the snapshot's columns and gives one per key.  It has to be associative, and giving it a row twice
has to change nothing (first, last, least, most), so that deliveries may come more than once and in any order.  Beyond
that a batch has a number: one that is not above the last published one has been applied before and is passed over.

A manifest names the data of each bucket.  A batch writes its buckets into a new folder and publishes a new manifest;
until then readers see the old one, and a batch that died is done again from the start.  Data that neither the newest
manifest nor the one before it names is deleted, so a reader has until the second next batch to finish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fieldbook.sources.published import Manifest


class KeyedStore:
    """The snapshot under `path`.  The number of buckets is fixed with the first batch: a part of one is a task's work, all of it where buckets outnumber shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.keys, self.fold, self.buckets = spark, path.rstrip("/"), keys, fold, buckets
        self.manifest = Manifest(spark, self.path)

    def _read(self, said: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(said["schema"])
        paths = [f"{self.path}/{said['buckets'][b]}" for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The snapshot as last published."""
        said = self.manifest.current()[1]
        if said is None:
            raise ValueError(f"nothing published in {self.path}")
        return self._read(said, sorted(said["buckets"]))

    def _dealt(self, rows: DataFrame, buckets: int) -> DataFrame:
        """rows shuffled once for both, the fold and the files: by the hash that buckets go by, into a multiple of their number, so that a part lies in one bucket."""
        wanted = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(buckets * max(1, wanted // buckets), *self.keys)

    def apply(self, batch: DataFrame, number: int) -> list[int]:
        """Merges a batch of the snapshot's columns; returns the buckets that were rewritten (none for one applied before).

        A null key is a key like any other.
        """
        version, said = self.manifest.current()
        if said is not None and number <= said["batch"]:
            return []
        buckets = said["of"] if said else self.buckets
        by = said.get("by", "xxhash64") if said else "hash"
        bucket = F.pmod(getattr(F, by)(*self.keys), F.lit(buckets)).cast("int")
        batch = batch.persist()  # the batch is read once: for its buckets, and to be merged
        try:
            touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most `buckets` numbers
            known = [str(b) for b in touched if said and str(b) in said["buckets"]]
            rows = self.fold(self._dealt(self._read(said, known).unionByName(batch) if known else batch, buckets))
            target = f"data/{version + 1:012d}"
            if touched:
                rows.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{target}")
            now = {**(said["buckets"] if said else {}), **{str(b): f"{target}/_bucket={b}" for b in touched}}
            self.manifest.publish(version + 1, {"batch": number, "of": buckets, "by": by, "buckets": now, "schema": rows.schema.jsonValue()})
        finally:
            batch.unpersist()
        self.manifest.clean()
        return touched
