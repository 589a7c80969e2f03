"""Outreach lists and edges, retention by expiry, signed events, link labels and small codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from fieldbook.functions import encode, text
from fieldbook.operators import changes, outreach, selection
from fieldbook.plans.facets import TAGS
from fieldbook.plans.links import PROBED, report
from fieldbook.plans.outreach import AS_OF, SAVED, saved, today
from fieldbook.plans.registry import fill, query, values
from fieldbook.plans.text import DISPLAY, FIRSTS, PHONES_SQL
from fieldbook.sources.tables import CONTACTS, RESOURCES, TAXONOMY, TAXONOMY_SQL, contacts, resources, table, taxonomy

# fixed values: what a link's status is called
STATUS_LABELS = [("live", "Link live"), ("dead", "Link dead"), ("uncertain", "Link uncertain"), ("off-topic", "Off-topic link"), ("invalid", "Invalid link")]
# fixed values: seconds for which a signed event is fresh
FRESH = 300
GOAL = 3


@query(f"""with {CONTACTS}, l as (select resource_id, max(day) as last_day, count(*) as n from contacts group by resource_id)
select v.view, resource_id, last_day from l, (values ('7d', 7), ('30d', 30), ('all', 100000)) v(view, days) where last_day > date '{AS_OF}' - days and last_day <= date '{AS_OF}'""")
def contact_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the last seven days, of thirty and of all: one row per list and resource."""
    last = contacts(spark, sf_dir).groupBy("resource_id").agg(F.max("day").alias("last_day")).where(F.col("last_day") <= today())
    age = F.datediff(today(), "last_day")
    views = F.array_compact(F.array(F.when(age < 7, "7d"), F.when(age < 30, "30d"), F.lit("all")))
    return last.select(F.explode(views).alias("view"), "resource_id", "last_day")


RUNS = f"""{CONTACTS}, w as (select distinct resource_id, (day - date '2023-12-31') // 7 as week from contacts),
r as (select *, week - row_number() over (partition by resource_id order by week) as run from w),
s as (select resource_id, week, row_number() over (partition by resource_id, run order by week) as streak from r)"""


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resource_id, week and how many weeks in a row, up to it, had a contact (gaps and islands)."""
    weeks = contacts(spark, sf_dir).select("resource_id", F.floor(F.datediff("day", F.lit("2023-12-31").cast("date")) / 7).alias("week")).distinct()
    run = F.col("week") - F.row_number().over(Window.partitionBy("resource_id").orderBy("week"))
    return weeks.withColumn("run", run).withColumn("streak", F.row_number().over(Window.partitionBy("resource_id", "run").orderBy("week")).cast("long")).select("resource_id", "week", "streak")


@query(f"with {RUNS} select resource_id, week, streak, max(streak) over (partition by resource_id order by week rows unbounded preceding) as record from s")
def streak_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest streak so far, for every week with a contact: it never falls.  A resource has one row a week, so windows are small."""
    so_far = Window.partitionBy("resource_id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return streaks(spark, sf_dir).withColumn("record", F.max("streak").over(so_far))


@query(f"with {RUNS} select resource_id, week, streak from s where streak in ({', '.join(map(str, outreach.MILESTONES))})")
def streak_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks in which a streak reaches a milestone."""
    return streaks(spark, sf_dir).where(F.col("streak").isin(*outreach.MILESTONES))


@query(f"""with {CONTACTS}, d as (select resource_id, (day - date '2023-12-31') // 7 as week, day, count(*) as n from contacts group by all),
s as (select *, sum(n) over (partition by resource_id, week order by day rows unbounded preceding)::bigint as total from d) select resource_id, week, day, total from s where total >= {GOAL} and total - n < {GOAL}""")
def goal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day on which a week's contacts first met the goal: from not met to met."""
    week = F.floor(F.datediff("day", F.lit("2023-12-31").cast("date")) / 7)
    days = contacts(spark, sf_dir).groupBy("resource_id", week.alias("week"), "day").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("resource_id", "week").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("total", total).where((F.col("total") >= GOAL) & (F.col("total") - F.col("n") < GOAL)).select("resource_id", "week", "day", "total")


@query(f"""with {SAVED}, {CONTACTS}, l as (select saved.resource_id, category, c_name as name, c_acctbal as rating, max(day) as last_day from saved join customer on c_custkey = saved.resource_id
  left join contacts on contacts.resource_id = saved.resource_id group by all),
p as (select 'name' as sort, resource_id, row_number() over (order by name, resource_id) as place from l union all select 'category', resource_id, row_number() over (order by category, resource_id) from l
  union all select 'rating', resource_id, row_number() over (order by rating desc, resource_id) from l union all select 'contacted', resource_id, row_number() over (order by last_day desc nulls last, resource_id) from l)
select sort, resource_id, place::int as place from p where place <= 24""")
def saved_sort_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of saved resources by each of the four orders."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("rating"))
    last = contacts(spark, sf_dir).groupBy("resource_id").agg(F.max("day").alias("last_day"))
    rows = saved(spark, sf_dir).join(c, "resource_id").join(last, "resource_id", "left")
    orders = {"name": F.col("name"), "category": F.col("category"), "rating": F.col("rating").desc(), "contacted": F.col("last_day").desc_nulls_last()}
    pages = [rows.orderBy(o, "resource_id").limit(24).withColumn("place", F.row_number().over(Window.orderBy(o, "resource_id"))).select(F.lit(k).alias("sort"), "resource_id", "place")
             for k, o in orders.items()]  # windows of a page
    return pages[0].union(pages[1]).union(pages[2]).union(pages[3])


@query(f"""with {PROBED}, labels(status, label) as {values(STATUS_LABELS)} select w.page_id, label, status = 'live' as live from pages w left join report using (page_id) left join labels using (status)""")
def link_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its last status' label; the report is joined by id, the labels are five rows."""
    labels = F.broadcast(spark.createDataFrame(STATUS_LABELS, "status string, label string"))
    rows = table(spark, sf_dir, "pages").select("page_id").join(report(spark, sf_dir).select("page_id", "status"), "page_id", "left")
    return rows.join(labels, "status", "left").select("page_id", "label", (F.col("status") == "live").alias("live"))


@query("select event_id, user_id, ts from events where ts + interval 6 hours > timestamp '2024-01-20 00:00:00' or event_type = 'purchase'")
def expiry_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a log of attempts when those that have expired are purged; one namespace (purchases) is not purged."""
    live = F.col("ts") + F.expr("interval 6 hours") > F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where(live | (F.col("event_type") == "purchase")).select("event_id", "user_id", "ts")


_INNER, _OUTER = (pad.hex() for pad in encode.pads("secret"))
SIGNED = f"""e as (select event_id, floor(epoch(ts))::bigint as t, event_id::varchar as payload from events),
s as (select *, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || (t || '.' || payload)::blob))) as signature from e)"""


#: Deliveries of events: when each was signed, by what, and when it is checked (the time of the next event); some are tampered with.
DELIVERED = f"""with {SIGNED}, o as (select *, coalesce(lead(t) over (order by t, event_id), t) as now, case when event_id % 11 = 3 then upper(signature) when event_id % 11 = 5 then reverse(signature) when event_id % 11 = 7 then null else signature end as given from s)"""


@query(f"""{DELIVERED} select event_id, signature, now - t <= {FRESH} as fresh, coalesce(given = signature, false) as genuine,
  case when given is null or given <> signature or now - t > {FRESH} then 'Invalid signature.' else 'ok' end as outcome, make_timestamp(t * 1000000) as occurred_at from o""")
def signed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of events compared with those that came with them, whether they are fresh within 300 seconds, and the outcome.

    The time of the next event is when one is checked; it comes by place, as events are numbered range by range.
    """
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = selection.numbered(table(spark, sf_dir, "events").select("event_id", t.alias("t")), [F.col("t"), F.col("event_id")], "place")
    after = rows.select((F.col("place") - 1).alias("place"), F.col("t").alias("now"))
    k = F.col("event_id") % 11
    signed = rows.withColumn("signature", encode.hmac("secret", F.concat_ws(".", F.col("t").cast("string"), F.col("event_id").cast("string"))))
    given = F.when(k == 3, F.upper("signature")).when(k == 5, F.reverse("signature")).when(k == 7, F.lit(None)).otherwise(F.col("signature"))
    both = signed.withColumn("given", given).join(after, "place", "left").withColumn("fresh", F.abs(F.coalesce("now", "t") - F.col("t")) <= FRESH)
    outcome = F.when(F.col("given").isNull() | (F.col("given") != F.col("signature")) | ~F.col("fresh"), "Invalid signature.").otherwise("ok")
    return both.select("event_id", "signature", "fresh", F.coalesce(F.col("given") == F.col("signature"), F.lit(False)).alias("genuine"), outcome.alias("outcome"), F.timestamp_seconds("t").cast("timestamp_ntz").alias("occurred_at"))


@query(f"""with {RESOURCES}, p as (select id, {fill(FIRSTS, fill(PHONES_SQL, 'phone_raw'))} as p from resources)
select id, array_to_string(list_transform(p, lambda d: case when length(d) = 10 then {fill(DISPLAY, 'd')} else d end), ' · ') as phones from p where p is not null""")
def phone_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of a record for the dashboard, in order; numbers of other lengths as they are."""
    shown = F.transform(text.phones(F.col("phone_raw")), lambda d: F.when(F.length(d) == 10, text.phone_display(d)).when(
        (F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 "), text.phone_display(F.substring(d, 2, 10)))).otherwise(d))
    return resources(spark, sf_dir).where("phone_raw is not null").select("id", F.array_join(shown, " · ").alias("phones"))


@query(f"""with {RESOURCES} select m.mode, id from resources, (values ('true'), ('false'), ('all')) m(mode) where mode = 'all' or published = (mode = 'true')""")
def published_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-way filter: published, not published, or all."""
    modes = F.array(F.lit("all"), F.when(F.col("published"), "true").otherwise("false"))
    return resources(spark, sf_dir).select(F.explode(modes).alias("mode"), "id")


@query(f"with {RESOURCES} select id, name, case when phone_raw is null and email is null then 'no contact' when not verified then 'unverified' else 'in review' end as reason from resources where not published")
def pending_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public side of the pending register: names and reasons, nothing else."""
    reason = F.when(F.col("phone_raw").isNull() & F.col("email").isNull(), "no contact").when(~F.col("verified"), "unverified").otherwise("in review")
    return resources(spark, sf_dir).where(~F.col("published")).select("id", "name", reason.alias("reason"))


@query(f"""with {RESOURCES}, e as (select category, count(distinct id) as expected from resources join lineitem on l_partkey = id group by category)
select category, count(*) as n, count(*) filter (published) as published, count(*) filter (not published) as pending, coalesce(max(expected), 0) as expected,
  coalesce(max(expected), 0) = count(*) and count(distinct id) = count(*) as ready from resources left join e using (category) group by category""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published and pending entries by category, and whether as many distinct ones are there as the orders' lines name."""
    named = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    rows = resources(spark, sf_dir)
    expected = named.join(rows.select("id", "category"), "id").groupBy("category").agg(F.count(F.lit(1)).alias("expected"))
    found = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("published").alias("published"), F.count_if(~F.col("published")).alias("pending"), F.countDistinct("id").alias("ids"))
    both = found.join(expected, "category", "left").withColumn("expected", F.coalesce("expected", F.lit(0).cast("long")))
    return both.select("category", "n", "published", "pending", "expected", ((F.col("n") == F.col("expected")) & (F.col("ids") == F.col("n"))).alias("ready"))


@query(f"with {RESOURCES} select id, published from resources where id in (18, 20, 25) or id = (select max(id) from resources)")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by id, published or not."""
    last = resources(spark, sf_dir).agg(F.max("id").alias("id"))
    some = F.broadcast(spark.createDataFrame([(18,), (20,), (25,)], "id long").union(last).distinct())  # four rows
    return resources(spark, sf_dir).join(some, "id", "left_semi").select("id", "published")


@query(f"with {RESOURCES} select id, name from resources where published order by md5('20011:' || id), id limit 1")
def random_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry at random by a seed: the smallest digest, found by a top-1 without a sort of all."""
    draw = F.md5(F.concat(F.lit("20011:"), F.col("id").cast("string")))
    return resources(spark, sf_dir).where(F.col("published")).orderBy(draw, "id").limit(1).select("id", "name")


SLUGS = ", ".join(repr(slug) for slug, _ in TAXONOMY)


@query(f"""with {RESOURCES} select id, 'q=' || replace(replace(replace(name, '%', '%25'), ' ', '%20'), '#', '%23') || case when priority > 0 then '&priorityOnly=true' else '' end || '&category=' || category as query,
  name as q, priority > 0 as priority_only, case when category in ({SLUGS}) then category else 'all' end as category from resources""")
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search as a query string and what is read back from it: a category outside the taxonomy is read as all."""
    rows = resources(spark, sf_dir)
    said = F.concat(F.lit("q="), encode.uri_component(F.col("name")), F.when(F.col("priority") > 0, "&priorityOnly=true").otherwise(""), F.lit("&category="), "category")
    parts = F.str_to_map("query", F.lit("&"), F.lit("="))
    known = F.when(parts["category"].isin([slug for slug, _ in TAXONOMY]), parts["category"]).otherwise("all")
    return rows.select("id", said.alias("query")).select("id", "query", F.url_decode(parts["q"]).alias("q"), F.coalesce(parts["priorityOnly"] == "true", F.lit(False)).alias("priority_only"), known.alias("category"))


@query(f"""with {CONTACTS}, legacy as (select c_custkey as resource_id, date '2024-01-01' + (c_custkey % 40)::int as day from customer),
m as (select resource_id, day from contacts union select resource_id, day from legacy), r as (select *, row_number() over (partition by resource_id order by day desc) as k from m)
select resource_id, day from r where k <= 50""")
def legacy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of an older log join those of the newer one, each once; the newest 50 of a resource stay."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 40).cast("int")).alias("day")
    legacy = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource_id"), day)
    merged = contacts(spark, sf_dir).select("resource_id", "day").union(legacy).distinct()
    return changes.newest(merged, ["resource_id"], [F.col("day").desc()], 50)


@query(f"""with {RESOURCES}, {TAXONOMY_SQL}, t as ({TAGS}), f as (select tag, count(*) as n from t group by tag),
c as (select 'category' as kind, short_name as value, position as pos from taxonomy where contains(lower(short_name), 'e') order by position limit 4),
g as (select 'tag' as kind, tag as value, n from f order by n desc, tag limit 8), m as (select 'name' as kind, name as value, priority, id from resources where published and contains(lower(name), 'e') order by priority desc, name, id limit 8)
select kind, value from c union all select kind, value from g union all select kind, value from m""")
def suggest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, tags and names as one list with a kind: at most four, eight and eight rows."""
    some = taxonomy(spark).where(F.lower("short_name").contains("e")).orderBy("position").limit(4).select(F.lit("category").alias("kind"), F.col("short_name").alias("value"))
    rows = resources(spark, sf_dir).where(F.col("published"))
    tags = rows.select(F.explode(F.split(F.lower("tags"), ",")).alias("tag")).withColumn("tag", text.strip(F.col("tag"))).where((F.col("tag") != "") & F.col("tag").contains("e"))
    tags = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").limit(8).select(F.lit("tag").alias("kind"), F.col("tag").alias("value"))
    names = rows.where(F.lower("name").contains("e")).orderBy(F.col("priority").desc(), "name", "id").limit(8).select(F.lit("name").alias("kind"), F.col("name").alias("value"))
    return some.union(tags).union(names)


@query("""select event_id, '{' || case when json_type(said, '$.type') = 'VARCHAR' then '"type":"' || json_extract_string(said, '$.type') || '"' else '' end || '}' as details
from (select event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":' || case when event_id % 3 = 0 then 'null' else '"' || event_type || '"' end || '}' as said from events)""")
def string_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an event's properties the strings only, 50 at most, in order."""
    said = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"type":'), F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.concat(F.lit('"'), "event_type", F.lit('"'))), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json(said).alias("v"))
    strings = F.filter(F.map_entries(F.variant_get("v", "$", "map<string,variant>")), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    kept = F.map_from_entries(F.transform(F.slice(strings, 1, 50), lambda e: F.struct(e["key"], F.variant_get(e["value"], "$", "string"))))
    return rows.select("event_id", F.to_json(kept).alias("details"))


@query(f"""with {RESOURCES}, c as (select * from resources where published and verified and (phone_raw is not null or {fill(PHONES_SQL, "coalesce(phone_raw, '')")}[1] is not null) order by priority desc, name, id limit 200)
select id, name from c where contains(lower(tags || ' ' || subcategory), 'hotline') or contains(lower(tags || ' ' || subcategory), 'tin') order by priority desc, name, id limit 50""")
def hotlines_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As hotlines, for entries with a raw phone or a normalised one."""
    order = (F.col("priority").desc(), F.col("name"), F.col("id"))
    rows = resources(spark, sf_dir).withColumn("phone", text.phone(F.col("phone_raw")))
    first = rows.where(F.col("published") & F.col("verified") & (F.col("phone_raw").isNotNull() | F.col("phone").isNotNull())).orderBy(*order).limit(200)
    words = F.lower(F.concat_ws(" ", "tags", "subcategory"))
    return first.where(words.contains("hotline") | words.contains("tin")).orderBy(*order).limit(50).select("id", "name")
