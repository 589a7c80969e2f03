"""Collections as arrays of ids, joined with the entries they name through an index from member to collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def members(collections: DataFrame, entries: DataFrame) -> DataFrame:
    """collection_id, place and the columns of the entry for each member of collections (collection_id, members) that is among entries (id).

    Places are those in the array, from 0; null members and those without an entry (orphans) have no row.
    """
    index = collections.select("collection_id", F.posexplode("members").alias("place", "id")).where("id is not null")
    return index.join(entries, "id")


def counted(collections: DataFrame, entries: DataFrame) -> DataFrame:
    """Each collection with its number of members, of those found, and of orphans; counted before the shuffle, so size is no matter."""
    found = members(collections, entries.select("id")).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n_found"))
    sizes = collections.select("collection_id", F.coalesce(F.array_size("members"), F.lit(0)).cast("long").alias("n_members"))
    return sizes.join(found, "collection_id", "left").select(
        "collection_id", "n_members", F.coalesce("n_found", F.lit(0)).alias("n_found"), (F.col("n_members") - F.coalesce("n_found", F.lit(0))).alias("n_orphans"))


def containing(collections: DataFrame, entries: DataFrame) -> DataFrame:
    """The other way: each entry's id with the number of collections that have it, none included."""
    index = collections.select("collection_id", F.explode(F.array_distinct("members")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_collections"))
    return entries.select("id").join(index, "id", "left").select("id", F.coalesce("n_collections", F.lit(0)).alias("n_collections"))
