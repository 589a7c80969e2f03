"""Search over parts (short fields) and over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from fieldbook.functions.patterns import SPACE
from fieldbook.operators import search, vocabulary
from fieldbook.plans.registry import query
from fieldbook.sources.published import shared_folder
from fieldbook.sources.tables import RESOURCES, resources, spread, table

ASKED = "Onmant of erster rapport 3 src3"
PARTS = "small rign Brand#2 hotline"
FIELDS = {"name": "name", "description": "description", "category": "category", "subcategory": "subcategory"}
ENTRIES = """entries as (select doc_id as id, left(text, 60) as name, text as description, source as category, lang as subcategory,
  (n_chars % 3)::int as priority from documents)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as directory entries."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("name"), F.col("text").alias("description"), F.col("source").alias("category"),
        F.col("lang").alias("subcategory"), (F.col("n_chars") % 3).cast("int").alias("priority"))


def score_sql(field: str, token: str) -> str:
    w, tolerance = search.WEIGHTS[field], 1 if len(token) <= 4 else 2
    words = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({field}), '[^a-z0-9{SPACE[1:]}', ' ', 'g'), '{SPACE}+'), lambda x: abs(length(x) - {len(token)}) <= 2 and x <> ''))"
    least = f"list_min(list_transform({words}, lambda x: levenshtein(x, '{token}')))"
    acronym = f"when lower({field}) = '{token}' then {12 * w} " if field == "acronym" else ""
    return (f"coalesce(case {acronym}when regexp_matches(lower({field}), '\\b{token}') then {4 * w} when contains(lower({field}), '{token}') then {2.5 * w} "
            f"when {least} <= {tolerance} then (2 - {least} * 0.6) * {w} else 0 end, 0)::double")


def scored_sql(rows: str, fields: list[str], text: str) -> str:
    words = search.query_tokens(text)
    sums = ", ".join(f"{' + '.join(score_sql(f, w) for w in words)} as _{f}" for f in fields)
    total = " + ".join(f"_{f}" for f in fields)
    matched = ", ".join(f"case when _{f} > 0 then '{f}' end" for f in fields)
    return (f"s as (select *, {sums} from {rows}), r as (select *, round(({total}) * case when priority >= 1 then 1.15 else 1 end, 6) as score, "
            f"array_to_string([{matched}], ',') as matched from s)")


LONG = f"with {ENTRIES}, {scored_sql('entries', list(FIELDS), ASKED)} "
PART_FIELDS = ["name", "acronym", "tags", "category", "subcategory", "address", "phone_raw", "phone_normalized", "email", "website", "source_note"]
SHORT = f"""with {RESOURCES}, whole as (select *, case when id % 3 = 0 then 'Smal Street ' || id end as address, regexp_replace(phone_raw, '[^0-9]', '', 'g') as phone_normalized, case when id % 4 = 1 then 'from brand_hotline 2 of ' || acronym end as source_note
  from resources where published), {scored_sql('whole', PART_FIELDS, PARTS)} """


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published entries with all the fields that are searched."""
    k = F.col("id")
    return resources(spark, sf_dir).where("published").withColumns({
        "address": F.when(k % 3 == 0, F.concat(F.lit("Smal Street "), k.cast("string"))), "phone_normalized": F.regexp_replace("phone_raw", "[^0-9]", ""),
        "source_note": F.when(k % 4 == 1, F.concat(F.lit("from brand_hotline 2 of "), "acronym"))})


@query(LONG + "select id, score, priority, matched from r where score > 0 order by score desc, priority desc, id limit 24")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page over whole documents; for one question a scan is cheaper than an index.  Names are texts here, so ties go by id."""
    found = search.score(entries(spark, sf_dir), ASKED)
    return found.orderBy(F.col("score").desc(), F.col("priority").desc(), "id").limit(24).where("score > 0").select("id", "score", "priority", F.array_join("matched", ",").alias("matched"))


QUESTIONS = {"typos": ASKED, "twice": "rapport Rapport report", "short": "zu 3", "long": "Informationsverarbeitungssystemen " + "x" * 30, "none": "the of", "code": "src12 sr"}
QUESTIONS_SQL = " union all ".join(
    f"select * from (with {scored_sql('entries', list(FIELDS), text)} select '{name}' as question, row_number() over (order by score desc, priority desc, id)::int as place, id, score, priority, matched from r where score > 0 limit 24)"
    for name, text in QUESTIONS.items() if search.query_tokens(text))


def _ranked(spark: SparkSession, sf_dir: str, questions: dict[str, str], most: int = 24) -> DataFrame:
    """The first rows of each question's ranking; one index serves all."""
    rows = entries(spark, sf_dir)
    found = vocabulary.Index(spark, shared_folder(spark)).build(rows).search(questions)
    boost = F.when(F.col("priority") >= 1, F.lit(1.15)).otherwise(F.lit(1.0))
    scored = found.join(rows.select("id", "priority"), "id").withColumn("score", F.round(F.col("score") * boost, 6))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.col("score").desc(), F.col("priority").desc(), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("question", "place", "id", "score", "priority", F.array_join("matched", ",").alias("matched"))


@query(f"with {ENTRIES} {QUESTIONS_SQL}")
def search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each of several questions over whole documents; words said twice, long ones and stop words alone are among them."""
    return _ranked(spark, sf_dir, QUESTIONS)


@query(SHORT + "select id, name, score, matched from r where score > 0 order by score desc, priority desc, name, id offset 24 limit 24")
def search_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page over short fields, with the fields that matched."""
    asked, limit, offset = search.parameters(PARTS, 24, 24)
    found = search.search(parts(spark, sf_dir), asked, limit, offset)
    return found.select("id", "name", "score", F.array_join("matched", ",").alias("matched"))


@query(SHORT + "select count(*) as total, round(max(score), 6) as best from r where score > 0")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.score(parts(spark, sf_dir), PARTS)
    return scored.agg(F.count_if(F.col("score") > 0).alias("total"), F.max(F.when(F.col("score") > 0, F.col("score"))).alias("best"))


@query(f"with {RESOURCES} select id, name from resources where published order by name, id limit 24")
def search_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of stop words only: everything by name."""
    return search.search(resources(spark, sf_dir).where("published"), "the of and", 24).select("id", "name")


@query(f"""select doc_id, len(t) as n_tokens, sha256(array_to_string(t, ' ')) as sha256 from (select doc_id,
  list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9{SPACE[1:]}', ' ', 'g'), '{SPACE}+'), lambda w: w <> '') as t from documents)""")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", search.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("sha256"))


@query("select p_partkey, p_name, levenshtein(split_part(p_name, ' ', 2), 'widgte') as distance from part where levenshtein(split_part(p_name, ' ', 2), 'widgte') <= 2")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.levenshtein(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("widgte"), 2)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", distance.alias("distance")).where("distance >= 0")


@query(f"with {RESOURCES} select id, regexp_replace(name, '(?i)(widget|red)', '<mark>\\1</mark>', 'g') as marked from resources")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select("id", search.highlight(F.col("name"), "Red widget").alias("marked"))
