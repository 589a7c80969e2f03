"""Readers of the driver's tables, and the directory's entities derived from them (with the SQL that says the same)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: the taxonomy, as (slug, short name)
TAXONOMY = [
    ("child-abduction", "Child & Family Abduction"),
    ("victim-rights-compensation", "Victim Rights & Compensation"),
    ("domestic-violence-family-violence", "Domestic & Family Violence"),
    ("family-advocacy-trauma-recovery", "Advocacy & Trauma Recovery"),
    ("protective-parent-family-court", "Protective Parents & Family Court"),
    ("gaslighting-darvo-institutional-betrayal", "DARVO & Institutional Betrayal"),
    ("parental-alienation-fathers-rights", "Parental Alienation & Fathers' Rights"),
    ("legal-aid-court-access", "Legal Aid & Court Access"),
    ("attorneys-firms", "Attorneys & Firms"),
    ("disability-medical-advocacy", "Disability & Medical Advocacy"),
    ("victim-linked-programs", "Victim-Linked Programs"),
    ("lyme-co-infections", "Lyme & Co-Infections"),
    ("housing-financial-aid", "Housing & Financial Aid"),
]
#: Categories that occur; the last is outside the taxonomy, and two of the taxonomy never occur.
USED = [slug for slug, _ in TAXONOMY[:11]] + ["uncategorised"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they are read by fewer tasks or unevenly: for costly work on texts and lines.

    A file's splits say little of that, as all rows of a row group come with one of them; so the rows that each task
    reads are counted.  Rows are dealt by their number, which needs no sorting, into several parts a core.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    read = rows.select(F.spark_partition_id().alias("task")).groupBy("task").count()
    tasks, most, whole = read.agg(F.count(F.lit(1)), F.max("count"), F.sum("count")).first()
    if tasks >= cores and most * cores <= 2 * whole:
        return rows
    return rows.withColumn("_row", F.monotonically_increasing_id()).repartition(4 * cores, "_row").drop("_row")


def taxonomy(spark: SparkSession) -> DataFrame:
    """13 rows, so always broadcast."""
    return F.broadcast(spark.createDataFrame([(i, *row) for i, row in enumerate(TAXONOMY)], "position int, slug string, short_name string"))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory entries made of parts."""
    p, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    number = F.lpad((k % 10000).cast("string"), 4, "0")
    return p.select(
        k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("acronym"), F.lower("p_type").alias("subcategory"),
        F.concat(F.col("p_type"), F.lit(", "), F.replace("p_name", F.lit(" "), F.lit(",")), F.when(size % 4 == 0, ",Hotline").otherwise(",source:part")).alias("tags"),
        F.element_at(F.array(*[F.lit(c) for c in USED]), size % len(USED) + 1).alias("category"),
        (size % 3).alias("priority"), (size % 5 != 0).alias("published"), (size % 7 != 0).alias("verified"),
        F.when(k % 4 != 0, F.concat(F.lit("voice 602-555-"), number, F.when(k % 3 == 0, F.concat(F.lit(" or 1-800-THE-LOST"))).otherwise(""))).alias("phone_raw"),
        F.when(k % 3 != 0, F.concat(F.lit(" Info@P"), k.cast("string"), F.lit(".org "))).alias("email"),
        F.when(k % 5 != 0, F.concat(F.lit("Example"), k.cast("string"), F.lit(".ORG/a%20b/"))).alias("website"),
        F.col("p_retailprice").alias("price"))


RESOURCES = f"""resources as (select p_partkey as id, p_name as name, p_brand as acronym, lower(p_type) as subcategory,
  p_type || ', ' || replace(p_name, ' ', ',') || case when p_size % 4 = 0 then ',Hotline' else ',source:part' end as tags,
  ([{', '.join(repr(c) for c in USED)}])[p_size % {len(USED)} + 1] as category, p_size % 3 as priority, p_size % 5 <> 0 as published,
  p_size % 7 <> 0 as verified,
  case when p_partkey % 4 <> 0 then 'voice 602-555-' || lpad((p_partkey % 10000)::varchar, 4, '0') || case when p_partkey % 3 = 0 then ' or 1-800-THE-LOST' else '' end end as phone_raw,
  case when p_partkey % 3 <> 0 then ' Info@P' || p_partkey || '.org ' end as email,
  case when p_partkey % 5 <> 0 then 'Example' || p_partkey || '.ORG/a%20b/' end as website, p_retailprice as price from part)"""

TAXONOMY_SQL = "taxonomy(position, slug, short_name) as (values " + ", ".join(
    f"({i}, '{slug}', '{name.replace(chr(39), chr(39) * 2)}')" for i, (slug, name) in enumerate(TAXONOMY)) + ")"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact log made of events: one row per contact with a resource."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("resource_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("method"),
        F.to_date("ts").alias("day"), "ts")


CONTACTS = """contacts as (select event_id as id, user_id as resource_id, nullif(event_type, 'error') as method, ts::date as day, ts from events)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of requests made of line items: many per request."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("stage"), F.col("l_returnflag").alias("decision"), F.col("l_shipdate").alias("reviewed_at"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"))


REVIEWS = """reviews as (select l_orderkey as request_id, l_linenumber as stage, l_returnflag as decision, l_shipdate as reviewed_at, l_partkey as part_id,
  l_suppkey as supplier_id from lineitem)"""
