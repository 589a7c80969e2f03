"""Outreach analytics: weekly activity, streaks, cadence and follow-up lists.  `AS_OF` stands for today."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from fieldbook.operators import outreach, selection
from fieldbook.plans.registry import fill, query
from fieldbook.sources.tables import CONTACTS, RESOURCES, contacts, resources, table

AS_OF = "2024-01-31"


def today() -> Column:
    return F.lit(AS_OF).cast("date")


WEEKS = f"""{CONTACTS}, w as (select w, count(id) as n from (select unnest(range(8)) as w) left join contacts on (date '{AS_OF}' - day) // 7 = w and date '{AS_OF}' >= day group by w)"""
USERS = f"""{CONTACTS}, w as (select resource_id, (date '{AS_OF}' - day) // 7 as w, count(*) as n from contacts where day <= date '{AS_OF}' and (date '{AS_OF}' - day) < 56 and method = 'signup' group by all)"""


@query(f"""with {WEEKS} select 7 - w as bucket, strftime(date '{AS_OF}' - (w * 7 + 6)::int, '%b %-d') as label, strftime(date '{AS_OF}' - (w * 7 + 6)::int, '%b %-d, %Y') as dated, n, sum(n) over ()::bigint as total, greatest(1, max(n) over ()) as scale from w""")
def weekly_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight weeks that end today, oldest first, empty ones included."""
    weeks = outreach.weekly(contacts(spark, sf_dir), "day", today())
    totals = weeks.agg(F.sum("n").alias("total"), F.greatest(F.lit(1), F.max("n")).alias("scale"))
    return weeks.crossJoin(F.broadcast(totals)).select("bucket", F.date_format("begins", "MMM d").alias("label"), F.date_format("begins", "MMM d, yyyy").alias("dated"), "n", "total", "scale")  # eight rows by one


STREAK = """list_reduce({0}, lambda a, n: case when a % 2 = 1 then a when n > 0 then a + 2 when a > 0 then a + 1 else a end, 0) // 2"""


@query(f"""with {USERS}, c as (select resource_id, list_transform(range(8), lambda i: coalesce(list_extract(map_extract(map(list(w), list(n)), i), 1), 0)) as c from w group by resource_id)
select resource_id, {fill(STREAK, 'c')} as streak, {fill(STREAK, 'c')} > 0 and c[1] = 0 as at_risk from c""")
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the latest run of weeks with a sign-up per resource, and whether this week is still empty."""
    signups = contacts(spark, sf_dir).where("method = 'signup'")
    weeks = outreach.weeks_of(signups, "resource_id", "day", today())
    run = outreach.streak(F.col("weeks"))
    return weeks.select("resource_id", run.cast("long").alias("streak"), ((run > 0) & (F.element_at("weeks", 1) == 0)).alias("at_risk"))


DAYS = f"{CONTACTS}, d as (select resource_id, day, count(*) as n from contacts group by all)"


@query(f"""with {DAYS} select resource_id, day, n, max(n) over (partition by resource_id order by day rows unbounded preceding) as record from d""")
def longest_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running record: it never falls.  Rows are days per resource, so windows are small."""
    days = contacts(spark, sf_dir).groupBy("resource_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("record", F.max("n").over(Window.partitionBy("resource_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"""with {DAYS}, s as (select *, sum(n) over (partition by resource_id order by day rows unbounded preceding)::bigint as total from d),
l as (select *, coalesce(lag(total) over (partition by resource_id order by day), 0) as prior from s), m as (select unnest([4, 8, 12, 16, 20, 26, 52]) as milestone)
select resource_id, day, milestone from l join m on prior < milestone and total >= milestone""")
def milestone_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a resource's number of contacts first reached a milestone."""
    days = contacts(spark, sf_dir).groupBy("resource_id", "day").agg(F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("resource_id").orderBy("day")
    sums = days.withColumn("total", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("prior", F.coalesce(F.lag("total").over(in_order), F.lit(0)))
    crossed = F.filter(F.array(*[F.lit(m) for m in outreach.MILESTONES]), lambda m: (m > F.col("prior")) & (m <= F.col("total")))
    return sums.select("resource_id", "day", F.explode(crossed).alias("milestone"))


@query(f"with {CONTACTS} select resource_id, max(day) as last_day, count(*) as n from contacts group by resource_id")
def last_contacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts(spark, sf_dir).groupBy("resource_id").agg(F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query(f"""with a as (select o_orderkey, (date '2000-01-01' - o_orderdate::date) as d from orders)
select o_orderkey, case when d <= 0 then 'today' when d = 1 then '1 day ago' when d < 30 then d || ' days ago' else (d // 30) || ' months ago' end as age from a""")
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", outreach.age(days).alias("age"))


@query(f"""with {CONTACTS} select resource_id, count(*) filter (day > date '{AS_OF}' - 30) as in_30_days, round(count(*) filter (day > date '{AS_OF}' - 30) / (30 / 7.0::double), 6) as per_week,
  max(day) < date '{AS_OF}' - 7 as follow_up_whole, max(day) < date '{AS_OF}' - 6 as follow_up_fractional from contacts group by resource_id""")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts per week over 30 days, and whether a follow-up is due by either rule (at noon of today)."""
    recent = F.count_if(F.col("day") > F.date_sub(today(), 30))
    last = F.max("day")
    noon = F.lit(AS_OF + " 12:00:00").cast("timestamp")
    return contacts(spark, sf_dir).groupBy("resource_id").agg(
        recent.alias("in_30_days"), F.round(recent / (30 / 7), 6).alias("per_week"), outreach.follow_up(last, noon, "whole_day").alias("follow_up_whole"),
        outreach.follow_up(last, noon, "fractional").alias("follow_up_fractional"))


@query("select user_id, coalesce(floor(sum(round(value * 100)::bigint) filter (value > 50)::double / (count(*) filter (value > 50) * 100) * 10000 + 0.5) / 10000, 0)::double as mean, count(*) filter (value > 50 or event_type = 'signup') as marked from events group by user_id")
def rating_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the ratings that count, 0 without any, and the number with a rating or a note."""
    rated = F.col("value") > 50
    cents = F.round(F.col("value") * 100).cast("long")
    mean = F.try_divide(F.sum(F.when(rated, cents)), F.count_if(rated) * 100)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.coalesce(F.floor(mean * 10000 + 0.5) / 10000, F.lit(0.0)).alias("mean"), F.count_if(rated | (F.col("event_type") == "signup")).alias("marked"))


SAVED = "saved as (select c_custkey as resource_id, c_mktsegment as category from customer where c_custkey % 2 = 0)"


@query(f"with {CONTACTS}, {SAVED} select coalesce(method, 'unspecified') as method, count(*) as n from contacts semi join saved using (resource_id) group by all")
def method_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with saved resources by method."""
    rows = contacts(spark, sf_dir).join(saved(spark, sf_dir), "resource_id", "left_semi")
    return rows.groupBy(F.coalesce("method", F.lit("unspecified")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("resource_id"), F.col("c_mktsegment").alias("category"))


@query(f"with {SAVED} select category, count(*) as n from saved group by category order by n desc, category limit 6")
def saved_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category").limit(6)


@query(f"with {CONTACTS}, {SAVED} select resource_id, id, category, day from contacts join saved using (resource_id) order by ts desc, id limit 3")
def recent_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest contacts with saved resources."""
    rows = contacts(spark, sf_dir).join(saved(spark, sf_dir), "resource_id")
    return rows.orderBy(F.col("ts").desc(), "id").limit(3).select("resource_id", "id", "category", "day")


@query(f"""with {CONTACTS}, {SAVED}, l as (select resource_id, max(day) as last_day from contacts group by resource_id)
select resource_id, last_day, row_number() over (order by last_day desc nulls last, resource_id)::int as place from saved left join l using (resource_id) order by place limit 100""")
def saved_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred saved resources by last contact, those never contacted last."""
    last = contacts(spark, sf_dir).groupBy("resource_id").agg(F.max("day").alias("last_day"))
    first = saved(spark, sf_dir).join(last, "resource_id", "left").orderBy(F.col("last_day").desc_nulls_last(), "resource_id").limit(100)
    place = F.row_number().over(Window.orderBy(F.col("last_day").desc_nulls_last(), "resource_id"))  # a hundred rows
    return first.select("resource_id", "last_day", place.alias("place"))


@query("""select n_nationkey, (1000 * (n_nationkey + 1)) as people, floor(1000 * (n_nationkey + 1) * 12.0 + 0.5)::bigint as annual, floor(floor(1000 * (n_nationkey + 1) * 12.0 + 0.5) * 0.85 + 0.5)::bigint as allocation,
  floor(1000 * (n_nationkey + 1) * 12.0 * 0.85 / 15000 + 0.5)::bigint as modeled from nation union all select -1, 1665481, 19985772, 16987906, 1133""")
def fund_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participation model: twelve months, 85 % to grants of 15,000; with the published example."""
    people = table(spark, sf_dir, "nation").select("n_nationkey", (1000 * (F.col("n_nationkey") + 1)).cast("long").alias("people"))
    people = people.unionByName(spark.createDataFrame([(-1, 1665481)], "n_nationkey int, people long"))
    return people.select("n_nationkey", "people", *outreach.fund(F.col("people"), F.lit(1)))


@query("select event_id, least(5, greatest(0, floor(value - 2 + 0.5)))::bigint as rating from events")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", outreach.clamp(F.col("value") - 2, 0, 5).alias("rating"))


def _picked_sql(first: str) -> str:
    return f"""with {RESOURCES}, pool as (select id, name from resources where published and ({first} or not exists (select 1 from resources where published and {first}))),
p as (select id, name, row_number() over (order by id) - 1 as k, count(*) over () as n from pool) select id, name from p where k = abs({outreach.day_hash('2026-8-9')}) % n"""


def _picked(spark: SparkSession, sf_dir: str, first: str) -> DataFrame:
    """The entry of the day among the published ones that `first` holds for, or all of them if it does for none."""
    rows = resources(spark, sf_dir).where("published").select("id", "name", "priority")
    pool = rows.where(first)
    return selection.nth((rows if pool.isEmpty() else pool).select("id", "name"), [F.col("id")], abs(outreach.day_hash("2026-8-9")))


@query(_picked_sql("priority >= 1"))
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the day among those with priority: place = hash of the date modulo their number."""
    return _picked(spark, sf_dir, "priority >= 1")


@query(_picked_sql("priority >= 9"))
def daily_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the day where no entry has priority: from the whole pool."""
    return _picked(spark, sf_dir, "priority >= 9")
