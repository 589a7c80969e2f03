"""Imports, updates, audit, retention, collections and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from fieldbook.functions.patterns import re2
from fieldbook.operators import changes, limiter, membership, toggles
from fieldbook.plans.registry import query
from fieldbook.plans.text import SAMPLES, clean_sql, docs, redact_sql, values
from fieldbook.functions import privacy, text
from fieldbook.sources.tables import CONTACTS, RESOURCES, REVIEWS, TAXONOMY, USED, contacts, resources, reviews, table

SLUGS = ", ".join(repr(slug) for slug, _ in TAXONOMY)


@query("""with c as (select conv_id, list(role = 'user' or role = 'assistant' order by turn) as consent, max(length(text)) as longest from conversations group by conv_id)
select conv_id, len(consent) as n, len(list_filter(consent, lambda x: not x)) = 0 as all_consent, coalesce(longest, 0) <= 5000 as bounded from c""")
def workflow_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consents all given and texts bounded; folded as counts, so a long conversation is combined before the shuffle."""
    given = F.col("role").isin("user", "assistant")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(~given) == 0).alias("all_consent"), (F.coalesce(F.max(F.length("text")), F.lit(0)) <= 5000).alias("bounded"))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F')")
def workflow_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("F")).select("o_orderkey", "o_orderstatus")


@query(f"""with {RESOURCES}, p as (select id, id % 2 = 0 as sets_email, case when id % 4 = 0 then 'new@x.org' end as new_email, case when id % 3 = 0 then 'renamed' end as new_name from resources)
select r.id, coalesce(p.new_name, r.name) as name, case when p.sets_email then p.new_email else r.email end as email, r.priority from resources r left join p on r.id = p.id""")
def patch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial update: what is left out stays, null clears, a value replaces; a name can't be cleared."""
    rows = resources(spark, sf_dir).select("id", "name", "email", "priority")
    fields = F.when(F.col("id") % 2 == 0, F.array(F.lit("name"), F.lit("email"))).otherwise(F.array(F.lit("name")))
    patches = rows.select("id", fields.alias("fields"), F.when(F.col("id") % 4 == 0, "new@x.org").alias("email"), F.when(F.col("id") % 3 == 0, "renamed").alias("name"))
    return changes.patch(rows, patches, "id", ("name",))


@query("""select 'audit' as kind, e.event_id as id, case when c_custkey is null then e.user_id end as parent_id from events e left join customer on c_custkey = user_id and c_custkey % 4 = 0
union all select 'result', o_orderkey, o_custkey from orders where o_custkey % 4 <> 0""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting customers divisible by four: the log keeps its rows without the reference, their results go."""
    gone = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("parent_id"))
    log = table(spark, sf_dir, "events").select(F.lit("audit").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("parent_id"))
    kept = log.join(gone.withColumn("gone", F.lit(True)), "parent_id", "left").select("kind", "id", F.when(F.col("gone").isNull(), F.col("parent_id")).alias("parent_id"))
    results = table(spark, sf_dir, "orders").select(F.lit("result").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"))
    return kept.unionByName(results.join(gone, "parent_id", "left_anti"))


@query("""select coalesce(f.id, c_custkey) as id, coalesce(f.segment, c_mktsegment) as segment from customer full join
(select c_custkey + 10 as id, case when c_custkey % 6 = 0 then null else lower(c_mktsegment) end as segment from customer where c_custkey % 2 = 0) f on f.id = c_custkey""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding: new values win, missing ones keep the old, nothing is deleted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    fresh = c.where("id % 2 = 0").select((F.col("id") + 10).alias("id"), F.when(F.col("id") % 6 != 0, F.lower("segment")).alias("fresh"))
    return c.join(fresh, "id", "full").select("id", F.coalesce("fresh", "segment").alias("segment"))


@query("""with d as (select l_orderkey || '-' || l_linenumber as event_id, floor(round(l_extendedprice * 100))::bigint as cents, l_linestatus as status, l_shipdate as d, l_partkey as p, l_suppkey as s from lineitem)
select event_id, arg_min(cents, (d, p, s)) as cents, arg_max(status, (d, p, s)) as status, count(*) as deliveries from d group by event_id""")
def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events delivered more than once: the first delivery's amount, the last one's status; combined before the shuffle."""
    d = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_linestatus").alias("status"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("at"))
    return d.groupBy("event_id").agg(F.min_by("cents", "at").alias("cents"), F.max_by("status", "at").alias("status"), F.count(F.lit(1)).alias("deliveries"))


DOCS = f"docs as (select doc_id, text from documents union all select * from {values(SAMPLES)})"
CLEANED = clean_sql(redact_sql("text"))


@query(f"with {DOCS} select doc_id, sha256({CLEANED}) as sha256, length(text) - coalesce(length({CLEANED}), 0) as removed from docs where text is distinct from {CLEANED}")
def cleanup_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the texts that cleaning changes; both versions come from one pass, so there is no join."""
    cleaned = F.explode(F.array(text.clean_artifacts(privacy.redact(F.col("text")))))  # a filter on what is generated is not pushed below it, which would clean twice
    fresh = docs(spark, sf_dir).withColumn("fresh", cleaned).where(~F.col("text").eqNullSafe(F.col("fresh")))
    return fresh.select("doc_id", F.sha2("fresh", 256).alias("sha256"), (F.length("text") - F.coalesce(F.length("fresh"), F.lit(0))).cast("long").alias("removed"))


@query(f"""with {RESOURCES} select 'publish' as action, id, 'Publish ' || name as summary, '{{"before":' || published || ',"after":' || (not published) || '}}' as details from resources where priority = 2""")
def audit_from_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of a publish toggle, derived from the rows that change."""
    return resources(spark, sf_dir).where("priority = 2").select(
        F.lit("publish").alias("action"), "id", F.concat(F.lit("Publish "), "name").alias("summary"),
        F.to_json(F.struct(F.col("published").alias("before"), (~F.col("published")).alias("after"))).alias("details"))


@query("""with r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id, event_id, k <= 10 as kept from r""")
def retention_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest runs of each key stay; the others are named for deletion."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    order = F.struct("ts", "event_id")
    newest = changes.newest(rows, ["user_id"], [order.desc()], 10)  # ranks stop at ten within each task, so a hot key is no burden
    bound = newest.groupBy("user_id").agg(F.min(order).alias("bound"))
    return rows.join(bound, "user_id").select("user_id", "event_id", (order >= F.col("bound")).alias("kept"))


@query(f"with {CONTACTS} select resource_id, id from (select *, row_number() over (partition by resource_id order by ts desc, id) as k from contacts) where k <= 50")
def cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 entries of each resource."""
    return changes.newest(contacts(spark, sf_dir), ["resource_id"], [F.col("ts").desc(), F.col("id")], 50).select("resource_id", "id")


@query("""with l as (select user_id, lower(event_type) as what, max(ts) as last_at from events group by all), r as (select *, row_number() over (partition by user_id order by last_at desc) as k from l)
select user_id, k::int as k, what, last_at from r where k <= 3""")
def recent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search history: the last use of each (whatever its case), the three latest per user; duplicates go before the shuffle."""
    last = table(spark, sf_dir, "events").groupBy("user_id", F.lower("event_type").alias("what")).agg(F.max("ts").alias("last_at"))
    ranked = last.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("last_at").desc())))
    return ranked.where("k <= 3").select("user_id", "k", "what", "last_at")


def _toggled(spark: SparkSession, sf_dir: str, most: int, evict: bool) -> DataFrame:
    item = F.get_json_object("props", "$.k").cast("long").alias("item")
    return toggles.replay(table(spark, sf_dir, "events").select("user_id", item, "ts", "event_id"), "user_id", "item", ["ts", "event_id"], most, evict)


def _toggled_sql(put: str, said: str, name: str) -> str:
    """All toggles of a user in order, with the list so far as the state of a recursion."""
    step = f"case when list_contains(s, item) then list_filter(s, lambda x: x <> item) else {put} end"
    return f"""with recursive e as (select user_id, (json_extract_string(props, '$.k'))::bigint as item, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (select user_id, k, [item] as s from e where k = 1 union all select e.user_id, e.k, {step} from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, array_to_string({said}, ',') as {name} from f semi join (select user_id, max(k) as k from e group by user_id) l using (user_id, k) where len(s) > 0"""


@query(_toggled_sql("list_prepend(item, s)[1:50]", "s", "saved"))
def toggle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved items after all toggles, newest first; beyond 50 the oldest is evicted."""
    return _toggled(spark, sf_dir, 50, True).select("user_id", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("saved"))


@query(_toggled_sql("case when len(s) < 3 then list_prepend(item, s) else s end", "list_reverse(s)", "compared"))
def compare_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared items after all toggles, oldest first; with 3 there, another is ignored."""
    items = F.transform(F.reverse("items"), lambda i: i.cast("string"))
    return _toggled(spark, sf_dir, 3, False).select("user_id", F.array_join(items, ",").alias("compared"))


@query("""with m as (select conv_id, unnest([turn % 20, (turn + conv_id) % 20]) as item from conversations) select conv_id, string_agg(distinct item, ',' order by item) as items from m where item <> 3 group by conv_id""")
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a collection after adding two items a turn and removing item 3; a set of at most 20."""
    item = F.explode(F.array(F.col("turn") % 20, (F.col("turn") + F.col("conv_id")) % 20)).alias("item")
    sets = table(spark, sf_dir, "conversations").select("conv_id", item).where("item <> 3").groupBy("conv_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return sets.select("conv_id", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


#: Collections of the parts of each order, and what is saved of them: published entries.
COLLECTED = f"with {RESOURCES}, c as (select l_orderkey as collection_id, l_partkey as id, l_linenumber, l_suppkey from lineitem), saved as (select id, name from resources where published)"


def collected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("collection_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("l"))
    return lines.select("collection_id", F.transform("l", lambda x: x["l_partkey"]).alias("members")), resources(spark, sf_dir).where("published").select("id", "name")


@query(f"{COLLECTED} select collection_id, count(*) as n_members, count(saved.id) as n_found, count(*) - count(saved.id) as n_orphans from c left join saved using (id) group by collection_id")
def collection_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collection's members, those that are saved, and how many are not."""
    return membership.counted(*collected(spark, sf_dir))


@query(f"{COLLECTED}, p as (select *, row_number() over (partition by collection_id order by l_linenumber, l_suppkey, id) - 1 as place from c) select collection_id, place::int as place, id, name from p join saved using (id)")
def collection_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved entries of each collection, at their places in it."""
    return membership.members(*collected(spark, sf_dir)).select("collection_id", "place", "id", "name")


@query(f"{COLLECTED} select saved.id, count(distinct collection_id) as n_collections from saved left join c using (id) group by saved.id")
def collections_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each saved entry with the number of collections that have it."""
    return membership.containing(*collected(spark, sf_dir))


@query(f"""with {RESOURCES} select count(*) as n, count(distinct id) as ids, count(*) - count(distinct id) as repeated, count(*) filter (name is null or name = '') as unnamed,
  count(*) filter (category not in ({SLUGS})) as uncategorised, count(*) filter (published) = count(*) as all_published from resources""")
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness, required fields, taxonomy and readiness in one row."""
    known = F.col("category").isin([slug for slug, _ in TAXONOMY])
    return resources(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), (F.count(F.lit(1)) - F.countDistinct("id")).alias("repeated"),
        F.count_if(F.coalesce("name", F.lit("")) == "").alias("unnamed"), F.count_if(~known).alias("uncategorised"),
        (F.count_if("published") == F.count(F.lit(1))).alias("all_published"))


@query("""with d as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y–%m–%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then 'unknown' end as said from orders)
select o_orderkey, coalesce(try_cast(regexp_replace(said, '[‐-―−]', '-', 'g') as date), date '2000-01-01') as day from d""")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with any dash; one that can't be read gets the default."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(k % 4 == 0, F.replace(d, F.lit("-"), F.lit("–"))).when(k % 4 == 1, d).when(k % 4 == 2, "unknown")
    day = F.regexp_replace(said, "[‐-―−]", "-").try_cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(day, F.lit("2000-01-01").cast("date")).alias("day"))


@query("""with recursive e as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (select user_id, k, event_id, true as accepted, [ts] as live from e where k = 1 union all
  select e.user_id, e.k, e.event_id, len(list_filter(f.live, lambda t: t > e.ts - interval 6 hours)) < 2,
    case when len(list_filter(f.live, lambda t: t > e.ts - interval 6 hours)) < 2 then list_append(list_filter(f.live, lambda t: t > e.ts - interval 6 hours), e.ts)
    else list_filter(f.live, lambda t: t > e.ts - interval 6 hours) end
  from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select event_id, user_id, accepted from f""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attempts in six hours per user; only accepted ones count."""
    return limiter.sliding(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 6 * 3600, 2).select("event_id", "user_id", "accepted")
