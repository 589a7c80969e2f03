"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldbook.llm import chat, counting, filter_audit, jaccard, language, lines, mixing, near_bytes, packing, periodic, simhash, topk, url_filter
from fieldbook.llm.job import tokenizer_file

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"),
                                          F.sha2("text", 256).alias("text_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(turns, tokenizer_file("byte_bpe_50k.tiktoken"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.labelled(filter_audit.text_failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return filter_audit.audit(rows, "part", list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(periodic.planted(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return (found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), "longest.length", (-F.col("longest.finer")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.finer")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_bytes.similar(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_chat_format, op4_simhash, op5_packing, op6_token_counts,
                                    op7_topk_search, op8_jaccard_join, op9_mixing, op10_url_filter, op11_filter_audit, op12_periodic_runs,
                                    op13_simhash_near_dedup)}


TOPK_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c::double))) = 0 and len(embedding) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

URL_FILTER_SQL = """
with rules(rhost, rpath, verdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rests as (select page_id, row_number() over () as n,
  case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
fits as (select n, rhost || rpath as rule, verdict, row_number() over (partition by n order by length(rhost) desc, length(rpath) desc) as k
  from parts join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (select * from fits where k = 1) using (n)
"""


MIXING_SQL = f"""
with recursive d as (select doc_id, source, row_number() over () as n,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
l as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over p, 0))
    / (sum(w) over () - coalesce(sum(w) over p, 0))::double as level
  from w window p as (order by source_size * 3 / w, source nulls last rows between unbounded preceding and 1 preceding)),
free as (select arg_min(level, 3 * source_size / w) as level from l where level * w <= 3 * source_size),
t as (select source, source_size, least((3 * source_size)::double, free.level * w) as target from l, free),
r as (select *, case when source_size > 0 then least(floor(target / source_size * {mixing.UNIT})::bigint, 3 * {mixing.UNIT}) else 0 end as rate,
  ('0x' || left(md5('{mixing.SEED}:' || coalesce(source, '')), {mixing.BITS // 4}))::bigint as u from t),
o as (select n, source, size, row_number() over (partition by source order by size desc, doc_id nulls first, n) as k from d),
b as (select source, coalesce(max(size) filter (k = {mixing.HEAD + 1}), 0) as bound from o group by source),
h as (select o.*, rate from o join b on o.source is not distinct from b.source join r on o.source is not distinct from r.source where size > bound),
f as (select n, source, size, k, rate, greatest(0, least(3, floor((2 * rate * size + size * {mixing.UNIT}) / (2 * size * {mixing.UNIT}))))::bigint as copies, rate * size - copies * size * {mixing.UNIT} as owed from h where k = 1
  union all select h.n, h.source, h.size, h.k, h.rate, greatest(0, least(3, floor((2 * (owed + h.rate * h.size) + h.size * {mixing.UNIT}) / (2 * h.size * {mixing.UNIT}))))::bigint as c,
    owed + h.rate * h.size - c * h.size * {mixing.UNIT} from f join h on h.source is not distinct from f.source and h.k = f.k + 1),
e as (select r.source, bound, source_size, target, u, least(3 * {mixing.UNIT}, greatest(0, rate + coalesce(case when source_size > spoken then floor(owed::double / (source_size - spoken)) else 0 end, 0)))::bigint as rate
  from r join b on r.source is not distinct from b.source left join (select source, arg_max(owed, k) as owed, sum(size) as spoken from f group by source) g on r.source is not distinct from g.source),
k as (select d.n, d.doc_id, d.source, d.size, source_size, target, rate, (row_number() over (partition by d.source
    order by length(bin(size)), floor(size / pow(2, length(bin(size)) - 1 - {mixing.DETAIL}))::bigint % {1 << mixing.DETAIL},
    coalesce(doc_id % {mixing.SLICES}, -1), size, doc_id) * rate)::bigint + u as ending
  from d join e on d.source is not distinct from e.source where size <= bound),
c as (select doc_id, source, size, source_size, target, (ending >> {mixing.BITS}) - ((ending - rate) >> {mixing.BITS}) as copies from k
  union all select d.doc_id, d.source, d.size, source_size, target, copies from f join d using (n) join e on f.source is not distinct from e.source)
select *, copies * size as taken from c
"""

AUDIT_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
f as (select part, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as cell, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from w left join marks using (doc_id)),
cells as (select part, cell, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
l(x, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from l a, l b, l c, l d, l e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, s::int as step, substr(filter_order, s, 1) as filter, bits[s] as own, coalesce(list_sum(bits[1 : s - 1]), 0)::int as earlier
  from orders, range(1, 6) r(s)),
counted as (select part, filter_order, step, filter,
    coalesce(sum(n) filter (cell & (own | earlier) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (cell & own > 0 and cell & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (cell & own > 0 and cell & earlier > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (cell = own), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (cell & own > 0 and cell & earlier = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (cell & own > 0 and cell & earlier = 0), 0)::bigint as toxic_lost
  from cells, steps group by all)
select *, (sum(removed) over (partition by part, filter))::bigint as shapley from counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_topk_search": TOPK_SQL, "op9_mixing": MIXING_SQL, "op10_url_filter": URL_FILTER_SQL, "op11_filter_audit": AUDIT_SQL}
