"""URL filtering by allow and block rules: a sort-merge range join on reversed-host keys.

A host's key is its labels in reverse order, each followed by a dot (``a.example.org`` is ``org.example.a.``).  The
host and subdomains of a rule are then one interval of keys, from the rule's key up to the same key with a slash in
place of its last dot, and any two intervals are nested or disjoint.  Intervals' ends and page keys are sorted
together; the sweep carries the stack of the rules that are open, and a page is judged by the longest rule on the
stack whose path its own path starts with.

Pages are dealt to sweeps by a hash of the row, so a host with a third of all pages is spread evenly; each sweep gets
the ends of all intervals (two per distinct rule host and sweep).  Only DataFrame functions are used.

Defined results: a null url or one without ``://`` has an empty host and path and no rule fits it; rules with a null
host or path are left out; of equal rules the last by verdict counts (block before allow is decided as block);
repeated pages give repeated rows; empty tables give empty results; other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def interval_ends(rules: DataFrame) -> DataFrame:
    """For each distinct rule host the two ends of its interval and the stack of rules that are open from there on."""
    rules = (rules.where("host is not null and path is not null")
             .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    rules = rules.withColumn("key", host_key(F.col("host")))
    own = rules.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        F.length("host").alias("host_chars"), F.length("path").alias("path_chars"),
        "path", F.concat("host", "path").alias("rule"), "verdict"))).alias("rules"))
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    outer = (own.select(F.col("key").alias("of"), labels.alias("labels"))
             .select("of", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"), "labels")
             .select("of", F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("n")), "."), F.lit(".")).alias("key")))
    stacks = (outer.join(own, "key").groupBy("of").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("key", "rules"))), lambda x: x["rules"])).alias("open"),
        F.flatten(F.transform(F.sort_array(F.filter(F.collect_list(F.when(F.col("key") != F.col("of"), F.struct("key", "rules"))),
                                                    lambda x: x.isNotNull())), lambda x: x["rules"])).alias("closed")))
    slash = F.concat(F.expr("left(of, length(of) - 1)"), F.lit("/"))
    return stacks.select(F.explode(F.array(
        F.struct(F.col("of").alias("key"), F.col("open").alias("stack")),
        F.struct(slash.alias("key"), F.col("closed").alias("stack")))).alias("end")).select("end.*")


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", sweeps: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict.

    `rules` has host, path and verdict.  The longest host wins, then the longest path.  `sweeps` is the number of
    independent sorted sweeps, by default the session's shuffle partitions.
    """
    n = sweeps or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("url"))
    pages = (pages.select("page_id", "url").select("page_id", F.pmod(F.xxhash64("page_id", "url"), F.lit(n)).alias("sweep"),
                                                   host.alias("host"), path.alias("path")))
    ends = interval_ends(rules).withColumn("sweep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    rows = (pages.withColumn("key", host_key(F.col("host"))).withColumn("is_page", F.lit(1))
            .unionByName(ends.withColumn("is_page", F.lit(0)), allowMissingColumns=True))
    sweep = Window.partitionBy("sweep").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("is_page = 1")
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["host_chars"], r["path_chars"], r["rule"], r["verdict"])))
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))
