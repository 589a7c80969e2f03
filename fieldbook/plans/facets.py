"""Scans, facets, coverage, tags, suggestions and the hotline list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from fieldbook.functions import links, text
from fieldbook.operators import selection
from fieldbook.plans.registry import fill, query
from fieldbook.sources.tables import RESOURCES, REVIEWS, TAXONOMY_SQL, resources, reviews, table, taxonomy

WITH = f"with {RESOURCES}, {TAXONOMY_SQL} "


def share(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(F.lit(0)).cast("long")


SHARE = "case when {1} > 0 then floor({0} * 100.0 / {1} + 0.5)::bigint else 0 end"


@query(WITH + "select id, name, category, priority from resources where published and priority >= 1 and category = 'attorneys-firms'")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir).where(F.col("published") & (F.col("priority") >= 1) & (F.col("category") == "attorneys-firms"))
    return rows.select("id", "name", "category", "priority")


@query(WITH + "select id, name, acronym, category from resources where id = (select min(id) from resources where published and priority = 2) and published")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One published entry by its id: the first of those with the highest priority."""
    rows = resources(spark, sf_dir).where("published")
    sought = rows.where("priority = 2").agg(F.min("id").alias("id"))
    return rows.join(F.broadcast(sought), "id", "left_semi").select("id", "name", "acronym", "category")  # sought is one row


@query("""select event_id, event_type, user_id, (select count(*) from events) as total, (select greatest(1, ceil(count(*) / 50.0))::bigint from events) as pages
from events order by ts desc, event_id offset 100 limit 50""")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the newest-first audit log, with the number of all rows and pages."""
    log = table(spark, sf_dir, "events")
    total = log.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 50)))
    page = log.orderBy(F.col("ts").desc(), "event_id").offset(100).limit(50).select("event_id", "event_type", "user_id")
    return page.crossJoin(F.broadcast(total))  # total is one row


@query("""with e as (select event_id, event_type, ts, row_number() over (order by ts desc, event_id) - 1 as k, count(*) over () as n from events)
select event_id, event_type from e where k >= n // 2 and k < n // 2 + 50""")
def page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows of the same log from its middle: only the ranges of the order that the page lies in are sorted."""
    log = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return selection.page(log, [F.col("ts").desc(), F.col("event_id")], log.count() // 2, 50).select("event_id", "event_type")


COVERED = [("with_phone", "phone_raw"), ("with_email", "email"), ("with_website", "website")]


@query(WITH + """select count(*) as total, count(*) filter (published) as published, count(*) filter (verified) as verified,
  count(phone_raw) as with_phone, count(email) as with_email, count(website) as with_website from resources""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("published").alias("published"), F.count_if("verified").alias("verified"),
        *[F.count(c).alias(name) for name, c in COVERED])


@query(WITH + """select category, count(*) as total, count(phone_raw) as with_phone, count(email) as with_email, count(website) as with_website
  from resources where published group by category""")
def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (resources(spark, sf_dir).where(F.col("published")).groupBy("category")
            .agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(name) for name, c in COVERED]))


@query(WITH + f"""select position, slug, short_name, count(id) as n, count(phone_raw) as with_phone, {fill(SHARE, 'count(phone_raw)', 'count(id)')} as phone_percent
  from taxonomy left join resources on slug = category and published group by all""")
def facet_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category of the taxonomy with its counts, 0 where it has no entry."""
    counts = resources(spark, sf_dir).where(F.col("published")).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count("phone_raw").alias("with_phone"))
    filled = taxonomy(spark).join(counts, F.col("slug") == F.col("category"), "left").fillna(0, ["n", "with_phone"])
    return filled.select("position", "slug", "short_name", "n", "with_phone", share(F.col("with_phone"), F.col("n")).alias("phone_percent"))


@query("""with s as (select page_id, (['live', 'dead', 'off-topic', 'uncertain'])[page_id % 4 + 1] as status from pages)
select count(*) as total, count(*) filter (status = 'live') as live, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'off-topic') as off_topic,
  count(*) filter (status = 'uncertain') as uncertain, count(*) filter (status = 'invalid') as invalid from s""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five statuses, 0 where none occurs (no page is invalid here)."""
    status = F.element_at(F.array(*[F.lit(s) for s in links.STATUSES[:4]]), (F.col("page_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select(status.alias("status"))
    return rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in links.STATUSES])


@query(WITH + """select tag, count(*) as n from (select unnest(list_filter(list_transform(split(tags, ','), lambda t: trim(t)), lambda t: t <> '')) as tag
  from resources where published) group by tag""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-sensitive, bookkeeping tags included."""
    return resources(spark, sf_dir).where(F.col("published")).select(F.explode(text.tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + f"""select id, array_to_string(list_filter(list_transform(split(tags, ','), lambda t: trim(t)), lambda t: t <> '' and not regexp_matches(t, '{text.INTERNAL_TAGS}')), '|') as visible
  from resources""")
def tags_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select("id", F.array_join(text.visible_tags(F.col("tags")), "|").alias("visible"))


@query(WITH + """, c as (select tag, count(*) as n from (select unnest(list_filter(list_transform(split(tags, ','), lambda t: trim(t)), lambda t: t <> '')) as tag from resources) group by tag)
select tag, n, 11 + floor(9.0 * n / max(n) over () + 0.5)::bigint as font, round(0.55 + 0.45 * n / max(n) over (), 6) as opacity from c""")
def tag_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag cloud: sizes in proportion to the most frequent tag; only its count is joined back."""
    counts = resources(spark, sf_dir).select(F.explode(text.tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    scaled = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("most"))))
    return scaled.select("tag", "n", (11 + F.floor(9 * F.col("n") / F.col("most") + 0.5)).alias("font"),
                         F.round(0.55 + 0.45 * F.col("n") / F.col("most"), 6).alias("opacity"))


@query("select o_orderpriority as reason, count(*) as n from orders group by o_orderpriority")
def pending_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""select count(*) as audit_rows, max(ts) as last_at, max(ts) filter (event_type = 'signup') as last_cleanup,
  (select string_agg(event_id, ',' order by ts desc, event_id) from (select * from events order by ts desc, event_id limit 10)) as recent from events""")
def admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit overview: number of rows, last times and the ten newest rows."""
    log = table(spark, sf_dir, "events")
    totals = log.agg(F.count(F.lit(1)).alias("audit_rows"), F.max("ts").alias("last_at"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last_cleanup"))
    newest = log.orderBy(F.col("ts").desc(), "event_id").limit(10)
    order = F.transform(F.sort_array(F.collect_list(F.struct(-F.unix_micros(F.col("ts").cast("timestamp")), "event_id"))), lambda r: r["event_id"].cast("string"))
    return totals.crossJoin(F.broadcast(newest.agg(F.array_join(order, ",").alias("recent"))))


@query(WITH + """select count(*) as total, count(*) filter (coalesce(phone_raw, '') = '') as missing_phone, count(*) filter (coalesce(email, '') = '') as missing_email,
  count(*) filter (coalesce(website, '') = '') as missing_website, count(*) filter (not verified) as unverified from resources""")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlike coverage, an empty value counts as missing."""
    missing = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "")
    return resources(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), missing("phone_raw").alias("missing_phone"), missing("email").alias("missing_email"),
                                        missing("website").alias("missing_website"), F.count_if(~F.col("verified")).alias("unverified"))


@query(WITH + "select id, category, coalesce(short_name, category) as label from resources left join taxonomy on slug = category")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir).join(taxonomy(spark), F.col("slug") == F.col("category"), "left")
    return rows.select("id", "category", F.coalesce("short_name", "category").alias("label"))


@query(WITH + """, m as (select * from taxonomy where contains(lower(short_name), 'ad') order by position limit 4)
select slug, short_name, count(id) as n from m left join resources on category = slug and published group by all""")
def suggest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four categories with "ad" in the name, with their counts."""
    matched = taxonomy(spark).where(F.lower("short_name").contains("ad")).orderBy("position").limit(4)
    counts = resources(spark, sf_dir).where(F.col("published")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return matched.join(counts, F.col("slug") == F.col("category"), "left").select("slug", "short_name", F.coalesce("n", F.lit(0)).alias("n"))


TAGS = """select trim(lower(t.tag)) as tag, priority, name, id, t.pos from resources, lateral (select unnest(split(tags, ',')) as tag, generate_subscripts(split(tags, ','), 1) as pos) t
  where published and contains(lower(t.tag), 'e') and trim(t.tag) <> ''"""


@query(WITH + f""", t as ({TAGS}), f as (select *, row_number() over (partition by tag order by priority desc, name, id, pos) as k, count(*) over (partition by tag) as n from t)
select tag, n from f where k = 1 order by n desc, priority desc, name, id, pos limit 8""")
def suggest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent tags with "e"; of equal counts the one seen first in (priority, name) order."""
    rows = resources(spark, sf_dir).where(F.col("published")).select("id", "name", "priority", F.posexplode(F.split(F.lower("tags"), ",")).alias("pos", "tag"))
    rows = rows.withColumn("tag", text.strip(F.col("tag"))).where((F.col("tag") != "") & F.col("tag").contains("e"))
    counts = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(-F.col("priority"), "name", "id", "pos")).alias("seen"))
    return counts.orderBy(F.col("n").desc(), "seen").limit(8).select("tag", "n")


NAMES = "select id, name, acronym, category, priority from resources where published and (contains(lower(name), 'ri') or contains(lower(acronym), 'ri')) order by priority desc, name, id limit 8"


@query(WITH + NAMES)
def suggest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir).where(F.col("published") & (F.lower("name").contains("ri") | F.lower("acronym").contains("ri")))
    return rows.orderBy(F.col("priority").desc(), "name", "id").limit(8).select("id", "name", "acronym", "category", "priority")


@query(WITH + f""", m as (select * from taxonomy where contains(lower(short_name), 'ad') order by position limit 4), s as ({NAMES})
select 'category' as kind, row_number() over (order by position) as pos, short_name as value from m
union all select 'name', row_number() over (order by priority desc, name, id), name from s""")
def suggest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and names as one list with a kind and a place (at most four and eight rows)."""
    matched = taxonomy(spark).where(F.lower("short_name").contains("ad")).orderBy("position").limit(4)
    names = suggest_names(spark, sf_dir)
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos")
    return matched.select(F.lit("category").alias("kind"), place("position"), F.col("short_name").alias("value")).unionByName(
        names.select(F.lit("name").alias("kind"), place(F.col("priority").desc(), "name", "id"), F.col("name").alias("value")))


@query(WITH + """, c as (select * from resources where published and verified and phone_raw is not null order by priority desc, name, id limit 200)
select id, name, priority, tags from c where contains(lower(tags || ' ' || subcategory), 'hotline') or contains(lower(tags || ' ' || subcategory), '24/7')
  or contains(lower(tags || ' ' || subcategory), 'crisis') order by priority desc, name, id limit 50""")
def hotlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 entries with a phone, then those with a keyword, then the first 50: the limit comes before the filter."""
    order = (F.col("priority").desc(), F.col("name"), F.col("id"))
    first = resources(spark, sf_dir).where(F.col("published") & F.col("verified") & F.col("phone_raw").isNotNull()).orderBy(*order).limit(200)
    words = F.lower(F.concat_ws(" ", "tags", "subcategory"))
    found = first.where(words.contains("hotline") | words.contains("24/7") | words.contains("crisis"))
    return found.orderBy(*order).limit(50).select("id", "name", "priority", "tags")


@query(f"""with {REVIEWS}, r as (select *, row_number() over (partition by request_id order by reviewed_at desc, stage, part_id, supplier_id) as k from reviews)
select o_orderkey as request_id, o_orderstatus as status, k::int as k, stage, decision, reviewed_at from orders left join r on request_id = o_orderkey and k <= 5""")
def lateral_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its five latest reviews."""
    latest = Window.partitionBy("request_id").orderBy(F.col("reviewed_at").desc(), "stage", "part_id", "supplier_id")
    top = reviews(spark, sf_dir).withColumn("k", F.row_number().over(latest)).where("k <= 5")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("status"))
    return requests.join(top, "request_id", "left").select("request_id", "status", "k", "stage", "decision", "reviewed_at")
