"""Link rules over pages, and reports of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldbook.functions import links, whatwg
from fieldbook.functions.patterns import re2
from fieldbook.operators import changes, selection
from fieldbook.plans.facets import SHARE, share
from fieldbook.plans.registry import fill, query, values
from fieldbook.sources.tables import table

#: Links for the rules that no page of the test tables sets off.
CASES = [
    "http://127.8.9.1/a", "http://10.20.30.40:8080/", "http://172.31.255.1", "http://192.168.77.7/x", "http://169.254.3.4/", "http://100.64.1.1", "http://localhost:3000/", "http://metadata/",
    "https://me:pass@site.example/", "gopher://site.example/", "https://site.example/a?b=c#d", "https://www.fiverr.com/gig", "https://reddit.com/r/help", "https://reddit.com",
    "https://facebook.com/login?next=1", "https://facebook.com/group", "https://l.facebook.com/login", "no link", "https://linktr.ee/me", "https://craigslist.org/search/roo", "http://172.15.0.9",
    "http://3232235777/", "http://0x0a000001/", "http://127.65530/", "http://0300.0250.1/", "http://134744072/", "http://1.2.3.256/", "http://1.2.3.4.5/", "http://a.b.09/", "http://site.0xg/",
    "http://[0:0:0:0:0:0:0:1]/", "http://[::1]/a", "http://[::]", "http://[fd12:3456::1]", "http://[FE80::1]", "http://[2001:db8::8:800:200c:417a]/", "http://[1:2:3:4:5:6:7:8:9]/", "http://[1::2::3]/",
    "http://[::ffff:10.1.2.3]/", "http://[::ffff:8.8.8.8]/", "http://[::ffff:a00:1]/", "http://[::1.2.3.256]/", "http://[12345::]/", "http://[1:2:3:4:5:6:7::]/", "http://[ff02::1]:80/", "http://[::1/",
    "http://a b.example/", "http://site.example:99999/", "http://site.example:65535/", "http://site.example:0080/", "http://site.example:8x/", "http://[::1]x/", "http://", "http:///reddit.com",
    "http://a<b.example/", "http://a%2Eb.example/", "http://a%20b.example/", "ftp://reddit.com/", "mailto:a@b.example", "http:\\\\10.0.0.1\\x", "\thttp://LOCALHOST ", "http://@site.example/", "http://:@site.example/",
]
SAMPLES = [(-1 - i, url) for i, url in enumerate(CASES)]
SITES = f"sites as (select page_id, url from pages union all select * from {values(SAMPLES)})"
PORTS = "(" + ", ".join(repr(s) for s in whatwg.DEFAULT_PORTS) + ")"
#: A part of a numeric host by its base, null if it is no number.
BASED = ("case when regexp_matches(x, '^0x[0-9a-f]*$') then coalesce(try_cast(nullif(x, '0x') as ubigint), 0)::bigint when regexp_matches(x, '^0[0-7]+$') then "
         "(list_sum(list_transform(range(length(x)), lambda i: substr(x, (i + 1)::int, 1)::bigint * pow(8, length(x) - 1 - i)::bigint)))::bigint "
         "when regexp_matches(x, '^(0|[1-9][0-9]*)$') then try_cast(x as bigint) end")
#: The parts of every link of `sites`, step by step: h is the host, v4 its address (-1: none it can be), p6 its pieces.
LINK = rf"""{SITES}, link0 as (select page_id, url, regexp_replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g') as t from sites),
link1 as (select *, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) as scheme, regexp_replace(t, '^[^:]*:[/\\]*', '') as behind from link0),
link2 as (select *, regexp_extract(behind, '^([^/\\?#]*)', 1) as place from link1),
link3 as (select *, substr(behind, length(place) + 1) as rest, regexp_replace(place, '^.*@', '') as seat from link2),
link4 as (select *, left(place, greatest(length(place) - length(seat) - 1, 0)) as person, regexp_extract(lower(seat), '^(\[[^\]]*\]|[^:]*)', 1) as raw from link3),
link5 as (select *, substr(seat, length(raw) + 1) as colon, lower(url_decode(raw)) as name, case when raw like '[%' then regexp_extract(raw, '^\[([0-9a-f:.]+)\]$', 1) end as six from link4),
link6 as (select *, case when regexp_matches(six, '\.') then case when regexp_matches(six, '^.*:((0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])\.){{3}}(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])$')
    then regexp_extract(six, '^(.*:)', 1) || printf('%x:%x', split_part(regexp_extract(six, '[^:]*$'), '.', 1)::int * 256 + split_part(regexp_extract(six, '[^:]*$'), '.', 2)::int,
      split_part(regexp_extract(six, '[^:]*$'), '.', 3)::int * 256 + split_part(regexp_extract(six, '[^:]*$'), '.', 4)::int) end else six end as hex6 from link5),
link7 as (select *, case when contains(hex6, '::') then list_filter(split(split_part(hex6, '::', 1), ':'), lambda x: x <> '') else split(hex6, ':') end as lefts,
  case when contains(hex6, '::') then case when substr(hex6, instr(hex6, '::') + 2) = '' then [] else split(substr(hex6, instr(hex6, '::') + 2), ':') end else [] end as rights from link6),
link8 as (select *, case when contains(hex6, '::') and len(lefts) + len(rights) < 8 then list_concat(lefts, list_concat(list_transform(range(8 - len(lefts) - len(rights)), lambda i: '0'), rights))
  when not contains(hex6, '::') and len(lefts) = 8 then lefts end as pieces from link7),
link9 as (select *, case when len(list_filter(pieces, lambda x: not regexp_matches(x, '^[0-9a-f]{{1,4}}$'))) = 0 then list_transform(pieces, lambda x: ('0x' || x)::int) end as p6,
  split(regexp_replace(name, '\.$', ''), '.') as dots from link8),
link10 as (select *, list_transform(dots, lambda x: {BASED}) as nums, regexp_matches(dots[-1], '^([0-9]+|0x[0-9a-f]*)$') as numeric from link9),
link11 as (select *, case when numeric then case when len(nums) <= 4 and len(list_filter(nums, lambda x: x is null)) = 0 and len(list_filter(nums[:len(nums) - 1], lambda x: x > 255)) = 0 and nums[-1] < pow(256, 5 - len(nums))
    then nums[-1] + coalesce(list_sum(list_transform(range(len(nums) - 1), lambda i: nums[(i + 1)::int] * pow(256, 3 - i)::bigint)), 0)::bigint else -1 end end as v4 from link10),
link12 as (select *, regexp_matches(colon, '^(:[0-9]*)?$') and coalesce(try_cast(nullif(substr(colon, 2), '') as bigint) <= 65535, substr(colon, 2) = '')
    and case when raw like '[%' then p6 is not null else name <> '' and not regexp_matches(name, '[\x00-\x20#/:<>?@\[\\\]^|%\x7F]') and coalesce(v4, 0) >= 0 end as fine,
  case when raw like '[%' then case when p6[1] = 0 and p6[2] = 0 and p6[3] = 0 and p6[4] = 0 and p6[5] = 0 and p6[6] = 65535 then p6[7]::bigint * 65536 + p6[8] end else v4 end as low from link11),
parts as (select *, case when scheme in {PORTS} then case when fine then regexp_replace(raw, '^\[|\]$', '', 'g') end when scheme <> '' then '' end as h,
  coalesce(nullif(regexp_extract(rest, '^([^#]*)', 1), ''), '/') as p, low >> 24 as a, (low >> 16) & 255 as b from link12)"""
SAFETY = f"""case when h is null then 'invalid-url' when scheme not in ('http', 'https') then 'scheme-not-allowed' when person not in ('', ':') then 'credentials-in-url'
  when name in ({', '.join(repr(x) for x in links.BLOCKED_HOSTS)}) then 'blocked-host'
  when low >= 0 and (a in (0, 10, 127) or a >= 224 or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 100 and b between 64 and 127)) then 'private-ip'
  when p6 is not null and (list_sum(p6[:7]) = 0 and p6[8] <= 1 or regexp_matches(printf('%x', p6[1]), '^(fe80|fc|fd|ff)')) then 'private-ip' else 'ok' end"""
OFF = "case " + " ".join(
    f"when regexp_replace(h, '^www\\.', '') in ({', '.join(repr(x) for x in hosts)})" + (f" and regexp_matches(p, '{re2(pattern)}')" if pattern else "") + f" then '{reason}'"
    for reason, hosts, pattern in links.OFF_TOPIC) + " end"
PROBED = f"""{LINK}, coded as (select *, case (page_id + 100) % 8 when 0 then 200 when 1 then 301 when 2 then 404 when 3 then 410
  when 4 then 403 when 5 then 500 when 6 then 429 end as code from parts),
probed as (select page_id, url, code, {OFF} as reason, {SAFETY} as safety, case when code is null then 'network-error' when code < 400 then 'ok' when code in (404, 410, 451) then 'dead'
  when code < 500 then 'restricted' else 'server-error' end as outcome from coded),
report as (select *, case when safety <> 'ok' then 'invalid' when reason is not null then 'off-topic' when outcome = 'ok' then 'live' when outcome = 'dead' then 'dead' else 'uncertain' end as status from probed)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(spark.createDataFrame(SAMPLES, "page_id long, url string"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified probes: fetching is not part of the engine, so the status code is a rule of page_id here."""
    codes = F.array(*[F.lit(c) for c in (200, 301, 404, 410, 403, 500, 429, None)])
    rows = sites(spark, sf_dir).withColumn("code", F.element_at(codes, F.pmod(F.col("page_id") + 100, F.lit(8)).cast("int") + 1))
    rows = rows.withColumns({"outcome": links.outcome(F.col("code"), F.lit("GET")), "parts": whatwg.parse(F.col("url"))})  # read once for both rules
    rows = rows.withColumns({"safety": links.safety_of(F.col("parts")), "reason": links.off_topic_of(F.col("parts"))}).drop("parts")
    return rows.withColumn("status", links.status(F.col("safety"), F.col("reason"), F.col("outcome")))


@query(f"with {PROBED} select page_id, safety from probed")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("page_id", links.safety(F.col("url")).alias("safety"))


@query(f"with {PROBED} select page_id, reason from probed where reason is not null")
def off_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).select("page_id", links.off_topic(F.col("url")).alias("reason")).where("reason is not null")


@query(f"with {PROBED} select page_id, code, outcome, status from report")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("page_id", "code", "outcome", "status")


@query(f"with {PROBED} select status, count(*) as n from report where status <> 'live' group by status")
def url_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of flagged links by status; url_flagged_lines has their lines."""
    return report(spark, sf_dir).where("status <> 'live'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {PROBED}, n as (select *, case when status = 'live' then 1 else 0 end as live, page_id::varchar as name from report)
select page_id, live, row_number() over (order by live, name, coalesce(url, ''), page_id) as place, case when live = 0 then status || chr(9) || page_id || chr(9) || coalesce(url, '') ||
  case when reason is not null then chr(9) || reason else '' end end as line from n""")
def url_flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links, flagged ones first, then by name (a page's id), with their place; each flagged one as a tab-separated line."""
    reason = F.when(F.col("reason").isNotNull(), F.concat(F.lit("\t"), "reason")).otherwise("")
    rows = report(spark, sf_dir).select("page_id", F.col("page_id").cast("string").alias("name"), (F.col("status") == "live").cast("int").alias("live"), "status", F.coalesce("url", F.lit("")).alias("url"), reason.alias("reason"))
    placed = selection.numbered(rows, [F.col("live"), F.col("name"), F.col("url"), F.col("page_id")], "place")
    line = F.concat("status", F.lit("\t"), "name", F.lit("\t"), "url", "reason")
    return placed.select("page_id", "live", "place", F.when(F.col("live") == 0, line).alias("line"))


@query(f"with {PROBED} select count(*) as total, count(*) filter (status = 'live') as live, {fill(SHARE, chr(99) + 'ount(*) filter (status = ' + repr('live') + ')', 'count(*)')} as percent from report")
def link_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = report(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "live").alias("live"))
    return total.select("total", "live", share(F.col("live"), F.col("total")).alias("percent"))


def customers(spark: SparkSession, sf_dir: str, fresh: bool) -> DataFrame:
    """A prior report, and a fresh one of every entry, half of them under new ids."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("code"))
    return (c.select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id") - 1).alias("id"), F.lower("status").alias("status"),
                                         F.lit(None).cast("int").alias("code")) if fresh else c)


@query("""with prior as (select c_custkey as id, c_mktsegment as status, c_nationkey as code from customer),
fresh as (select case when c_custkey % 2 = 0 then c_custkey else -c_custkey - 1 end as id, lower(c_mktsegment) as status, null::int as code from customer)
select * from fresh union all select * from prior where id not in (select id from fresh)""")
def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh row replaces the prior one whole, also where it has nulls; new rows are added."""
    return changes.override(customers(spark, sf_dir, False), customers(spark, sf_dir, True), ["id"])


@query("""select o_custkey as run_id, row_number() over (order by o_orderdate, o_orderkey) as place, o_orderkey as result from orders
where o_custkey = (select o_custkey from orders order by o_orderdate desc, o_orderkey desc limit 1)""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run, one row per result with its place; the run is found by one aggregate, and its results are placed range by range."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_custkey"))["o_custkey"].alias("run_id"))
    rows = orders.join(F.broadcast(newest), F.col("o_custkey") == F.col("run_id"))  # newest is one row
    placed = selection.numbered(rows.select("run_id", "o_orderdate", "o_orderkey"), [F.col("o_orderdate"), F.col("o_orderkey")], "place")
    return placed.select("run_id", "place", F.col("o_orderkey").alias("result"))
