"""Snapshots and their changes: upserts, partial updates and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def override(prior: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `fresh`, and those of `prior` whose key it has not; both have the same columns."""
    names = [c for c in prior.columns if c not in keys]
    old = prior.select(*keys, F.struct(*names).alias("_old"))
    new = fresh.select(*keys, F.struct(*names).alias("_new"))
    both = old.join(new, keys, "full").withColumn("_row", F.coalesce("_new", "_old"))
    return both.select(*keys, *[F.col("_row")[c].alias(c) for c in names])


def patch(rows: DataFrame, patches: DataFrame, key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Partial update: patches has the key, `fields` (names that are set) and values; one set to null is cleared.

    A required column keeps its value when it is set to null.
    """
    names = [c for c in rows.columns if c != key]
    p = patches.select(F.col(key), F.col("fields").alias("_fields"), *[F.col(c).alias(f"_{c}") for c in names if c in patches.columns])
    joined = rows.join(p, key, "left")

    def merged(c: str) -> Column:
        if c not in patches.columns:
            return F.col(c)
        value = F.coalesce(F.col(f"_{c}"), F.col(c)) if c in required else F.col(f"_{c}")
        return F.when(F.coalesce(F.array_contains("_fields", c), F.lit(False)), value).otherwise(F.col(c)).alias(c)

    return joined.select(key, *[merged(c) for c in names])


def newest(rows: DataFrame, by: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first `most` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
