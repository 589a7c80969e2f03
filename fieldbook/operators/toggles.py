"""Toggled sets with a capacity: what is there is taken out, what is not is put in front.

With a capacity the state depends on earlier evictions, so parity does not decide.  As in the rate limiter, each key is
read in order as a stream of Arrow batches; its state is at most `most` items, whatever the number of its toggles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType


def toggle(items: list, item: object, most: int, evict: bool) -> None:
    """Toggle an item, newest first; at capacity the oldest goes, or without `evict` the new one is ignored."""
    if item in items:
        items.remove(item)
    elif evict or len(items) < most:
        items.insert(0, item)
        del items[most:]


def replay(toggles: DataFrame, key: str, item: str, order: list[str], most: int, evict: bool) -> DataFrame:
    """key and `items` after all its toggles in order, newest first; keys with nothing left and null items are left out."""
    parts = int(toggles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = toggles.schema
    schema = StructType().add(key, types[key].dataType).add("items", ArrayType(types[item].dataType))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = task
        items: list = []
        for batch in batches:
            kinds = pa.schema([(key, batch.schema.field(key).type), ("items", pa.list_(batch.schema.field(item).type))])
            done: list[tuple] = []
            for k, i in zip(batch.column(key).to_pylist(), batch.column(item).to_pylist()):
                if k != here:
                    if items:
                        done.append((here, items))
                    here, items = k, []
                toggle(items, i, most, evict)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kinds.field(0).type), pa.array([v for _, v in done], kinds.field(1).type)], schema=kinds)
        if items:
            yield pa.RecordBatch.from_arrays([pa.array([here], kinds.field(0).type), pa.array([items], kinds.field(1).type)], schema=kinds)

    ordered = toggles.where(F.col(item).isNotNull()).repartition(parts, key).sortWithinPartitions(key, *order)
    return ordered.select(key, item).mapInArrow(task, schema)
