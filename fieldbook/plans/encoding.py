"""Exports and encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldbook.functions import encode, links, text
from fieldbook.functions.patterns import SPACE
from fieldbook.operators import digest, membership, selection
from fieldbook.plans.facets import SHARE, share
from fieldbook.plans.registry import fill, query, values
from fieldbook.plans.text import DISPLAY, FIRSTS, PHONES_SQL
from fieldbook.plans.workflow import COLLECTED, collected
from fieldbook.sources import documents
from fieldbook.sources.published import shared_folder
from fieldbook.sources.tables import CONTACTS, RESOURCES, TAXONOMY_SQL, contacts, resources, table, taxonomy

CELLS = [(-1, "=A1*3"), (-2, "+44 20"), (-3, "-5"), (-4, "@now"), (-5, "\t =1"), (-6, "plain"), (-7, '=LINK("x", "y")'), (-8, None), (-9, "<b class='x'>&\"</b>")]
TEXTS = f"texts as (select doc_id, text from documents union all select * from {values(CELLS)})"
SAFE = f"case when regexp_matches({{0}}, '^{SPACE}*[=+\\-@]') then '''' || {{0}} else coalesce({{0}}, '') end"
CELL = "case when regexp_matches(" + SAFE + ", '[\",\\r\\n]') then '\"' || replace(" + SAFE + ", '\"', '\"\"') || '\"' else " + SAFE + " end"
PHONE = "nullif(array_to_string(" + fill(FIRSTS, fill(PHONES_SQL, "{0}")) + ", ' | '), '')"
NUMBERS = "array_to_string(list_transform(" + fill(FIRSTS, "{0}") + ", lambda d: " + fill(DISPLAY, "d") + "), ' · ')"
HTML = "replace(replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(CELLS, "doc_id long, text string"))


@query(f"with {TEXTS} select doc_id, sha256(doc_id || ',' || {fill(CELL, 'text')}) as sha256, case when doc_id < 0 then {fill(CELL, 'text')} end as cell from texts where doc_id >= 0"
       f" union all select doc_id, sha256('''' || doc_id || ',' || {fill(CELL, 'text')}), {fill(CELL, 'text')} from texts where doc_id < 0")
def csv_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, text) of a CSV file as digests, and the cells of the samples."""
    cell = encode.csv_cell(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.sha2(encode.csv_row(F.col("doc_id"), F.col("text")), 256).alias("sha256"), F.when(F.col("doc_id") < 0, cell).alias("cell"))


@query(f"""with {TEXTS} select doc_id, sha256({fill(HTML, 'text')}) as sha256, sha256(replace({fill(HTML, 'text')}, '&#39;', chr(39))) as attribute_sha256, case when doc_id < 0 then {fill(HTML, 'text')} end as escaped from texts""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped for HTML, and for a quoted attribute, where apostrophes may stay."""
    escaped = encode.html(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.sha2(escaped, 256).alias("sha256"), F.sha2(encode.html_attribute(F.col("text")), 256).alias("attribute_sha256"),
                                       F.when(F.col("doc_id") < 0, escaped).alias("escaped"))


@query("""select event_id, (json_extract_string(props, '$.k'))::bigint as k, '{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}' as details from events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as a map of strings, with the type added."""
    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"), F.to_json(props).alias("details"))


@query("select distinct user_id, sha256('pepper:' || user_id) as key from events")
def hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().withColumn("key", F.sha2(F.concat_ws(":", F.lit("pepper"), F.col("user_id").cast("string")), 256))


BACKUP = ["id", "name", "acronym", "subcategory", "tags", "category", "priority", "published", "verified", "phone_raw", "email", "website", "price"]
JSON_TEXT = "'\"' || replace({0}, '\"', '\\\"') || '\"'"


def json_sql(columns: list[str]) -> str:
    """An object of the columns that are not null, as Spark writes it."""
    plain = {"id", "priority", "published", "verified"}
    said = lambda c: f"{c}::varchar" if c in plain else "case when price = floor(price) then price::bigint || '.0' else price::double::varchar end" if c == "price" else fill(JSON_TEXT, c)
    return "'{' || concat_ws(',', " + ", ".join(f"case when {c} is not null then '\"{c}\":' || {said(c)} end" for c in columns) + ") || '}'"


@query(f"with {RESOURCES} select id, {json_sql(BACKUP)} as line from resources")
def export_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every record as a JSON line, by priority and name; reading the lines back gives the same records."""
    rows = resources(spark, sf_dir).orderBy(F.col("priority").desc(), "name", "id")
    return rows.select("id", F.to_json(F.struct(*[F.col(c).cast("double").alias(c) if c == "price" else F.col(c) for c in BACKUP])).alias("line"))


HEAD = ["Name", "Category", "Phone", "Email"]


@query(f"""with {RESOURCES}, {TAXONOMY_SQL}, l as (select resources.*, coalesce(short_name, category) as label from resources left join taxonomy on slug = category)
select -1 as id, '{','.join(HEAD)}' || chr(13) || chr(10) as line union all
select id, {fill(CELL, 'name')} || ',' || {fill(CELL, 'label')} || ',' || {fill(CELL, 'phone_raw')} || ',' || {fill(CELL, 'email')} || chr(13) || chr(10) from l where published""")
def csv_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole CSV document: its head and a line per record, each with its line end; end to end they are the file."""
    head = spark.createDataFrame([(-1, *HEAD)], "id long, name string, label string, phone_raw string, email string")
    rows = resources(spark, sf_dir).where(F.col("published")).join(taxonomy(spark), F.col("slug") == F.col("category"), "left")
    rows = head.union(rows.select("id", "name", F.coalesce("short_name", "category"), "phone_raw", "email"))
    return rows.select("id", F.concat(encode.csv_row(*map(F.col, ("name", "label", "phone_raw", "email"))), F.lit("\r\n")).alias("line"))


@query(f"""with {RESOURCES}, {TAXONOMY_SQL}, l as (select resources.*, coalesce(short_name, category) as label from resources left join taxonomy on slug = category where published)
select id::varchar as id, nullif({fill(SAFE, 'name')}, '') as name, nullif({fill(SAFE, 'label')}, '') as label, nullif({fill(SAFE, 'phone_raw')}, '') as phone, nullif({fill(SAFE, 'note')}, '') as note
from (select *, case id % 5 when 0 then '=1+' || id when 1 then 'say "' || id || '", twice' when 2 then 'two' || chr(13) || chr(10) || 'lines' when 3 then ' -' || id end as note from l)""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a CSV document by the data source and read back by it: as they were, but for guarded formulas."""
    k = F.col("id")
    note = (F.when(k % 5 == 0, F.concat(F.lit("=1+"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit('say "'), k.cast("string"), F.lit('", twice'))).when(k % 5 == 2, "two\r\nlines")
            .when(k % 5 == 3, F.concat(F.lit(" -"), k.cast("string"))))
    rows = resources(spark, sf_dir).where("published").join(taxonomy(spark), F.col("slug") == F.col("category"), "left")
    line = F.concat(encode.csv_row(k, F.col("name"), F.coalesce("short_name", "category"), F.col("phone_raw"), note), F.lit("\r\n"))
    path = shared_folder(spark)
    documents.write(rows.select(line.alias("value")), path, head="id,name,label,phone,note\r\n")
    return documents.read_csv(spark, path, most_bytes=1 << 40)


#: A cell of the saved entries' file: quoted only for a comma, a quote or a line feed, and formulas are not guarded.
PLAIN_CELL = "case when contains({0}, ',') or contains({0}, '\"') or contains({0}, chr(10)) then '\"' || replace({0}, '\"', '\"\"') || '\"' else coalesce({0}, '') end"
# fixed values: the heads of the saved entries' and of a collection's file
SAVED_HEAD = ["Name", "Acronym", "Category", "Subcategory", "Description", "Phone (raw)", "Phone (normalized)", "Email", "Website", "Address", "Tags", "Priority", "Source Note", "Private Note", "Private Rating", "Last Contacted"]
COLLECTION_HEAD = ["Name", "Acronym", "Category", "Phone", "Email", "Website", "Address", "Tags"]
SAVED_CELLS = ["name", "acronym", "label", "subcategory", "null", "phone_raw", fill(PHONE, "phone_raw"), "email", "website", "null", "tags", "case when priority >= 1 then 'Priority' end", "null", "note", "rating", "contacted"]
LABELLED = "l as (select resources.*, coalesce(short_name, category) as label from resources left join taxonomy on slug = category)"
SAVED_SQL = f"""with {RESOURCES}, {TAXONOMY_SQL}, {LABELLED}, last as (select user_id as id, max(ts::date)::varchar as contacted, count(*) % 6 as times from events group by user_id),
s as (select l.*, contacted, nullif(times, 0)::varchar as rating, case when id % 3 = 0 then 'ask for "' || name || '", then call' end as note from l left join last using (id) where published)"""


def saved_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published entries as saved ones, with labels, a private note and rating, and the last day of contact."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.to_date("ts")).cast("string").alias("contacted"), (F.count(F.lit(1)) % 6).alias("times"))
    rows = resources(spark, sf_dir).where("published").join(taxonomy(spark), F.col("slug") == F.col("category"), "left").join(last, "id", "left")
    note = F.when(F.col("id") % 3 == 0, F.concat(F.lit('ask for "'), "name", F.lit('", then call')))
    return rows.withColumns({"label": F.coalesce("short_name", "category"), "note": note, "rating": F.nullif("times", F.lit(0)).cast("string"), "number": text.blank_to_null(F.array_join(text.phones(F.col("phone_raw")), " | "))})


@query(SAVED_SQL + " select -1 as id, '" + ",".join(SAVED_HEAD) + "' as line union all select id, " + " || ',' || ".join(fill(PLAIN_CELL, c) if c != "null" else "''" for c in SAVED_CELLS) + " from s")
def saved_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved entries' CSV file, a line a row: its head, and each entry with label, note, rating and last contact."""
    none = F.lit(None).cast("string")
    cells = ["name", "acronym", "label", "subcategory", none, "phone_raw", "number", "email", "website", none, "tags", F.when(F.col("priority") >= 1, "Priority"), none, "note", "rating", "contacted"]
    line = F.concat_ws(",", *[encode.plain_cell(F.col(c) if isinstance(c, str) else c) for c in cells])
    return spark.createDataFrame([(-1, ",".join(SAVED_HEAD))], "id long, line string").union(saved_entries(spark, sf_dir).select("id", line))


SAID = "coalesce(to_json({0})::varchar, 'null')"


@query(SAVED_SQL + " select id, '{\"id\":' || id || " + " || ".join(f"',\"{name}\":' || {value}" for name, value in (
    ("name", fill(SAID, "name")), ("acronym", fill(SAID, "acronym")), ("category", fill(SAID, "category")), ("categoryLabel", fill(SAID, "label")), ("phone", fill(SAID, fill(PHONE, "phone_raw"))),
    ("email", fill(SAID, "email")), ("priority", "priority"), ("privateNote", fill(SAID, "note")), ("privateRating", fill(SAID, "rating")), ("lastContacted", fill(SAID, "contacted")))) + " || '}' as line from s")
def saved_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved entries as elements of a JSON document, written by the data source and read back element by element."""
    rows = saved_entries(spark, sf_dir)
    said = F.to_json(F.struct("id", "name", "acronym", "category", F.col("label").alias("categoryLabel"), F.col("number").alias("phone"), "email", "priority", F.col("note").alias("privateNote"),
                              F.col("rating").alias("privateRating"), F.col("contacted").alias("lastContacted")), {"ignoreNullFields": "false"})
    path = shared_folder(spark)
    documents.write(rows.select(said.alias("value")), path, '{"exportType":"saved","resources":[', "]}", ",")
    return documents.read_json(spark, path, most_bytes=1 << 40).select(F.get_json_object("line", "$.id").cast("long").alias("id"), "line")


@query(f"""{COLLECTED}, {TAXONOMY_SQL}, {LABELLED}, p as (select *, row_number() over (partition by collection_id order by l_linenumber, l_suppkey, id) - 1 as place from c),
s as (select collection_id, place, l.*, {fill(PHONES_SQL, 'phone_raw')} as ps from p join l using (id) where published)
select collection_id, place::int as place, {fill(CELL, 'name')} || ',' || {fill(CELL, 'acronym')} || ',' || {fill(CELL, 'label')} || ',' || {fill(CELL, fill(NUMBERS, 'ps'))} || ',' || {fill(CELL, 'email')} || ',' || {fill(CELL, 'website')} || ',,' || {fill(CELL, 'tags')} as line from s
union all select distinct collection_id, -1, '{','.join(COLLECTION_HEAD)}' from c""")
def collection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV file of every collection, a line a row: its head (place -1), then the saved entries at their places."""
    lists, _ = collected(spark, sf_dir)
    entries = resources(spark, sf_dir).where("published").join(taxonomy(spark), F.col("slug") == F.col("category"), "left")
    shown = F.array_join(F.transform(text.phones(F.col("phone_raw")), lambda d: text.phone_display(d)), " · ")
    line = encode.csv_row(F.col("name"), F.col("acronym"), F.coalesce("short_name", "category"), shown, F.col("email"), F.col("website"), F.lit(None), F.col("tags"))
    rows = membership.members(lists, entries.select("id", line.alias("line"))).select("collection_id", "place", "line")
    return rows.union(lists.select("collection_id", F.lit(-1), F.lit(",".join(COLLECTION_HEAD))))


#: What stands before and after a printed document's cards.
STYLE = "body{font-family:serif;max-width:50em;margin:2em auto}.card{border:1px solid #bbb;padding:1em;margin:1em 0;break-inside:avoid}.label{font-weight:bold}.description{white-space:pre-wrap}"
OPENING = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Saved &amp; sorted</title><style>{STYLE}</style></head><body><h1>Saved &amp; sorted</h1>'
CLOSING = "</body></html>"
FIELD = "case when coalesce({1}, '') <> '' then '<div class=\"field\"><span class=\"label\">{0}:</span> <span class=\"value\">' || " + fill(HTML, "{1}") + " || '</span></div>' else '' end"
FIELDS = (("Category", "category"), ("Phone", "phone_raw"), ("Email", "email"), ("Address", "address"), ("Website", "website"), ("Tags", "tags"))
NOTES = (("Source Note", "source_note"), ("Your Notes", "notes"), ("Contact Log", "contact_log"))
CARD = ("'<section class=\"card\"><h2 class=\"card-title\">' || k || '. ' || " + fill(HTML, "name") + " || '</h2><div class=\"acronym\">(' || " + fill(HTML, "acronym") + " || ')</div>' || "
        + " || ".join(fill(FIELD, label, c) for label, c in FIELDS) + " || case when coalesce(description, '') <> '' then '<div class=\"description\">' || " + fill(HTML, "description") + " || '</div>' else '' end || "
        + " || ".join(fill(FIELD, label, c) for label, c in NOTES) + " || '</section>'")


@query(f"""with {RESOURCES}, d as (select doc_id as id, text as description from documents), last as (select user_id as id, max(ts::date)::varchar as contact_log from events group by user_id),
p as (select resources.*, description, contact_log, case when id % 2 = 0 then name || ' & Co, <1> "Main" St' end as address, case when id % 3 = 0 then 'from ' || acronym end as source_note, case when id % 5 = 0 then 'it''s <b>new</b>' end as notes,
  row_number() over (order by priority desc, name, id) as k from resources left join d using (id) left join last using (id) where published)
select 0 as place, sha256('{OPENING}') as part_sha256 union all select k, sha256({CARD}) from p union all select count(*) + 1, sha256('{CLOSING}') from p""")
def html_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed list of all records with descriptions, notes and contact logs: its beginning, an escaped card each, its end (as digests); in order they are the document."""
    k = F.col("id")
    rows = resources(spark, sf_dir).where(F.col("published")).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description")), "id", "left")
    rows = rows.join(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.to_date("ts")).cast("string").alias("contact_log")), "id", "left")
    rows = rows.withColumns({"address": F.when(k % 2 == 0, F.concat("name", F.lit(' & Co, <1> "Main" St'))), "source_note": F.when(k % 3 == 0, F.concat(F.lit("from "), "acronym")), "notes": F.when(k % 5 == 0, "it's <b>new</b>")})
    placed = selection.numbered(rows, [F.col("priority").desc(), F.col("name"), F.col("id")], "place")
    fields = lambda some: [encode.html_field(label, F.col(c)) for label, c in some]
    description = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit('<div class="description">'), encode.html(F.col("description")), F.lit("</div>"))).otherwise("")
    card = F.concat(F.lit('<section class="card"><h2 class="card-title">'), F.col("place").cast("string"), F.lit(". "), encode.html(F.col("name")), F.lit("</h2>"),
                    F.when(F.coalesce("acronym", F.lit("")) != "", F.concat(F.lit('<div class="acronym">('), encode.html(F.col("acronym")), F.lit(")</div>"))).otherwise(""),
                    *fields(FIELDS), description, *fields(NOTES), F.lit("</section>"))
    ends = spark.createDataFrame([(0, OPENING)], "place long, part string").union(placed.agg((F.count(F.lit(1)) + 1).alias("place"), F.lit(CLOSING).alias("part")))
    return placed.select("place", card.alias("part")).union(ends).select("place", F.sha2("part", 256).alias("part_sha256"))


@query(f"""with {RESOURCES}, {TAXONOMY_SQL} select id, name, coalesce(short_name, category) as category_label, phone_raw, email,
  regexp_replace(regexp_replace(url_decode(website), '(?i)^https?://', ''), '/$', '') as website_display, priority, verified from resources left join taxonomy on slug = category""")
def verification_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records to be verified, by priority and name, with labels and links as they are shown."""
    rows = resources(spark, sf_dir).join(taxonomy(spark), F.col("slug") == F.col("category"), "left").orderBy(F.col("priority").desc(), "name", "id")
    shown = F.when(F.col("website").isNotNull(), links.display(F.col("website")))
    return rows.select("id", "name", F.coalesce("short_name", "category").alias("category_label"), "phone_raw", "email", shown.alias("website_display"), "priority", "verified")


@query(f"""with {CONTACTS}, m as (select coalesce(method, 'unspecified') as method, count(*) as n from contacts group by all)
select method, n, {fill(SHARE, 'n', 'sum(n) over ()')} as percent, method || ',' || n || ',' || {fill(SHARE, 'n', 'sum(n) over ()')} || '%' as line from m""")
def dashboard_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's summary as CSV lines: contacts by method with their shares; methods are few."""
    counts = contacts(spark, sf_dir).groupBy(F.coalesce("method", F.lit("unspecified")).alias("method")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))  # one row
    percent = share(F.col("n"), F.col("all"))
    return whole.select("method", "n", percent.alias("percent"), F.concat(encode.csv_row(F.col("method"), F.col("n")), F.lit(","), percent.cast("string"), F.lit("%")).alias("line"))


@query(f"""with {RESOURCES}, {TAXONOMY_SQL}, p as (select resources.*, coalesce(short_name, category) as label, row_number() over (order by priority desc, name, id) as k, count(*) over () as n from resources
  left join taxonomy on slug = category where published)
select string_agg(k || '. ' || name || ' (' || label || ')', chr(10) order by k) || case when max(n) > 10 then chr(10) || '… and ' || (max(n) - 10) || ' more' else '' end as summary from p where k <= 10""")
def export_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text summary: the first ten entries, numbered, and how many more there are."""
    rows = resources(spark, sf_dir).where("published")
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    first = rows.orderBy(F.col("priority").desc(), "name", "id").limit(10).join(taxonomy(spark), F.col("slug") == F.col("category"), "left")
    entry = F.struct(-F.col("priority"), "name", "id", F.concat(F.col("name"), F.lit(" ("), F.coalesce("short_name", "category"), F.lit(")")).alias("said"))
    lines = F.transform(F.sort_array(F.collect_list(entry)), lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["said"]))
    text = first.agg(F.array_join(lines, "\n").alias("text")).crossJoin(F.broadcast(total))  # one row by one
    more = F.when(F.col("n") > 10, F.concat(F.lit("\n… and "), (F.col("n") - 10).cast("string"), F.lit(" more"))).otherwise("")
    return text.select(F.concat("text", more).alias("summary"))


@query(f"""with {RESOURCES}, l as (unpivot (select id, name, acronym, category, priority::varchar as priority from resources where id in (3, 5, 8)) on name, acronym, category, priority into name field value said)
select field, max(said) filter (id = 3) as a, max(said) filter (id = 5) as b, max(said) filter (id = 8) as c from l group by field""")
def compare_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three entries side by side: fields as rows."""
    rows = resources(spark, sf_dir).where(F.col("id").isin(3, 5, 8)).select("id", "name", "acronym", "category", F.col("priority").cast("string").alias("priority"))
    long = rows.unpivot("id", ["name", "acronym", "category", "priority"], "field", "said")
    slots = long.groupBy("field").pivot("id", [3, 5, 8]).agg(F.first("said"))
    return slots.select("field", F.col("3").alias("a"), F.col("5").alias("b"), F.col("8").alias("c"))


@query("""select p_partkey, case when trim(p_name) <> '' then 'https://maps.example.org/?q=' || replace(p_name || ' (' || p_brand || ')', ' ', '%20') end as link from
(select p_partkey, p_name, replace(p_brand, '#', '%23') as p_brand from part)""")
def maps_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    link = F.concat(F.lit("https://maps.example.org/?q="), encode.uri_component(address))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.trim("p_name") != "", link).alias("link"))


#: All tables with their columns and how each is written: S text, I integer, D double, T time, A an array of doubles.
TABLES = {
    "region": {"r_regionkey": "I", "r_name": "S"}, "nation": {"n_nationkey": "I", "n_name": "S", "n_regionkey": "I"}, "supplier": {"s_suppkey": "I", "s_name": "S", "s_nationkey": "I", "s_acctbal": "D"},
    "customer": {"c_custkey": "I", "c_name": "S", "c_nationkey": "I", "c_acctbal": "D", "c_mktsegment": "S"},
    "part": {"p_partkey": "I", "p_name": "S", "p_brand": "S", "p_type": "S", "p_size": "I", "p_retailprice": "D"},
    "orders": {"o_orderkey": "I", "o_custkey": "I", "o_orderstatus": "S", "o_totalprice": "D", "o_orderdate": "T", "o_orderpriority": "S"},
    "events": {"event_id": "I", "ts": "T", "user_id": "I", "event_type": "S", "value": "D", "props": "S"}, "pages": {"page_id": "I", "url": "S", "html": "S"},
    "documents": {"doc_id": "I", "text": "S", "lang": "S", "source": "S", "n_chars": "I"}, "embeddings": {"vec_id": "I", "embedding": "A", "label": "I"},
    "conversations": {"conv_id": "I", "turn": "I", "role": "S", "text": "S"}, "labels": {"doc_id": "I", "quality": "I", "toxic": "I"}, "benchmark": {"item_id": "I", "text": "S"},
    "lineitem": {"l_orderkey": "I", "l_partkey": "I", "l_suppkey": "I", "l_linenumber": "I", "l_quantity": "D", "l_extendedprice": "D", "l_discount": "D", "l_tax": "D", "l_returnflag": "S", "l_linestatus": "S", "l_shipdate": "T"},
}
#: A double in hexadecimal, as Java writes it.
HEXADECIMAL = r"regexp_replace(regexp_replace(printf('%a', {0}::double), '^(-?0x[0-9a-f])p', '\1.0p'), 'p\+', 'p')"
SIZED = "coalesce('{0}' || length({1}) || ':' || {1}, 'N')"
WRITTEN = {"S": fill(SIZED, "S", "{0}"), "I": fill(SIZED, "I", "{0}::varchar"), "D": fill(SIZED, "D", HEXADECIMAL), "T": fill(SIZED, "T", "epoch_us({0})::varchar"),
           "A": "coalesce('A' || len({0}) || ':' || array_to_string(list_transform({0}, lambda x: " + fill(SIZED, "D", fill(HEXADECIMAL, "x")) + "), ''), 'N')"}
DIGESTS = " union all ".join(
    f"select '{t}' as dataset, h from (select sha256(" + " || ".join(fill("length({0}) || ':' || {0}", f"('{c}=' || {fill(WRITTEN[kind], c)})") for c, kind in sorted(columns.items())) + f") as h from {t})" for t, columns in TABLES.items())
SUMS = " || ',' || ".join(f"sum(('0x' || substr(h, {1 + digest.WIDTH * i}, {digest.WIDTH}))::bigint)" for i in range(digest.LANES))


@query(f"""with rows as ({DIGESTS}), d as (select dataset, count(*) as n, sha256({SUMS}) as digest from rows group by dataset),
known as (select digest, n from d where dataset in ('region', 'orders') union all select digest, n + 1 from d where dataset in ('nation', 'part'))
select dataset, n, digest, exists (select 1 from known where known.digest = d.digest and known.n = d.n) as known from d""")
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each dataset over all its columns, whatever the order of its rows, and whether an import with it and as many rows is known.

    Known are two of the tables, with their rows in another order, and two others under a wrong number of rows.
    """
    of = lambda t, rows: digest.digest(rows).select(F.lit(t).alias("dataset"), "n", "digest")
    found = reduce(DataFrame.union, [of(t, table(spark, sf_dir, t)) for t in TABLES])
    known = reduce(DataFrame.union, [of(t, table(spark, sf_dir, t).repartition(7)).select("digest", F.col("n") + more) for t, more in (("region", 0), ("orders", 0), ("nation", 1), ("part", 1))])
    known = F.broadcast(known.toDF("digest", "n").withColumn("known", F.lit(True)))  # a row per import
    return found.join(known, ["digest", "n"], "left").select("dataset", "n", "digest", F.coalesce("known", F.lit(False)).alias("known"))
