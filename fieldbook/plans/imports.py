"""Imports and updates as JSON lines: validation by the full rules, bulk append and replace, updates with audit rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldbook.functions import privacy
from fieldbook.operators import imports, validation
from fieldbook.operators.validation import Field
from fieldbook.plans.registry import fill, query
from fieldbook.plans.text import EMAIL_SQL, FIRSTS, PHONES_SQL, SPAM_NOTES_SQL, clean_sql, pattern_count, redact_sql, squash_sql
from fieldbook.sources.published import shared_folder
from fieldbook.sources.tables import TAXONOMY, spread, table

SLUGS = tuple(slug for slug, _ in TAXONOMY)
# fixed values: limits of a record's fields, of a request's and of a review's
RECORD = {
    "name": Field(low=1, high=300, required=True), "acronym": Field(high=50, nullable=True), "description": Field(high=20000, nullable=True),
    "category": Field(required=True, values=SLUGS), "subcategory": Field(high=200, nullable=True), "phoneRaw": Field(high=200, nullable=True),
    "email": Field(high=300, nullable=True), "address": Field(high=1000, nullable=True), "website": Field(high=2000, nullable=True), "tags": Field(high=2000),
    "priority": Field("integer", 0, 10), "verified": Field("flag"), "published": Field("flag"), "sourceNote": Field(high=5000, nullable=True),
}
#: What a line of a bulk import may have beside these.
IMPORT = {
    **RECORD, "id": Field(low=1, high=200), "sourceCategory": Field(high=300, nullable=True), "phoneNormalized": Field(high=200, nullable=True), "phoneDisplay": Field(high=200, nullable=True),
    "piipassAt": Field("moment", nullable=True), "piipassNotes": Field(high=5000, nullable=True), "sourceDatasetHash": Field(high=128, nullable=True),
    "sourceRow": Field("integer", 1, 2**53 - 1, nullable=True), "createdAt": Field("moment", nullable=True), "updatedAt": Field("moment", nullable=True),
}
REQUEST = {
    "displayName": Field(high=200), "contactMethod": Field(values=("Text", "Phone", "Email", "Another method")), "contactDetails": Field(high=300), "location": Field(high=300),
    **{name: Field(high=5000) for name in ("situation", "urgentProblem", "blockers", "proposedHelp", "unwantedSupport")}, "deadline": Field(high=500),
    "alreadyWorking": Field(high=5000), "currentHelp": Field(high=2000), "planPreference": Field(values=("Yes", "No", "Not sure", "I want to build it myself")),
    "documentsNote": Field(high=2000), "consentRequired": Field("flags", 2, 2, required=True, all_true=True), "consentOptional": Field("flags", 0, 2),
}
REVIEW = {
    "status": Field(required=True, values=("received", "reviewing", "needs-info", "approved", "alternate-offered", "declined", "withdrawn", "closed")),
    "stage": Field("integer", 1, 2), "decision": Field(low=1, high=100, required=True), "reasonCode": Field(high=100), "notes": Field(high=5000),
}

#: Lines made of parts, in SQL that both engines read; each rule is broken by some of them.
RECORD_LINE = f"""case when p_partkey % 97 = 5 then '[1]' when p_partkey % 97 = 6 then '' else '{{' || concat_ws(',',
  case when p_partkey % 11 = 1 then null when p_partkey % 11 = 2 then '"name":"  "' when p_partkey % 11 = 3 then '"name":null' when p_partkey % 11 = 4 then '"name":7'
    when p_partkey % 11 = 5 then '"name":"' || repeat('n', 301) || '"' else '"name":" ' || p_name || '  "' end,
  case when p_partkey % 7 = 1 then '"acronym":"' || repeat('a', 51) || '"' when p_partkey % 7 = 2 then '"acronym":null' else '"acronym":" ' || repeat('a', 50) || ' "' end,
  case when p_partkey % 13 = 1 then '"description":"' || repeat('d', 20001) || '"' when p_partkey % 13 = 2 then '"description":""' end,
  case when p_partkey % 17 = 1 then '"category":"other"' when p_partkey % 17 = 2 then null else '"category":"{SLUGS[7]}"' end,
  case when p_partkey % 19 = 1 then '"subcategory":"' || repeat('s', 201) || '"' else '"subcategory":"' || lower(p_type) || '"' end,
  case when p_partkey % 23 = 1 then '"phoneRaw":"' || repeat('5', 201) || '"' end, case when p_partkey % 29 = 1 then '"email":"' || repeat('e', 301) || '"' end,
  case when p_partkey % 31 = 1 then '"address":"' || repeat('e', 1001) || '"' end, case when p_partkey % 37 = 1 then '"website":"' || repeat('e', 2001) || '"' end,
  case when p_partkey % 41 = 1 then '"tags":null' when p_partkey % 41 = 2 then '"tags":"' || repeat('t', 2001) || '"' else '"tags":"a, b"' end,
  case when p_partkey % 5 = 1 then '"priority":11' when p_partkey % 5 = 2 then '"priority":-1' when p_partkey % 5 = 3 then '"priority":"1"' else '"priority":' || (p_partkey % 10) end,
  case when p_partkey % 43 = 1 then '"verified":"yes"' when p_partkey % 43 = 2 then '"verified":null' else '"verified":true' end,
  case when p_partkey % 47 = 1 then '"published":0' else '"published":false' end, case when p_partkey % 53 = 1 then '"sourceNote":"' || repeat('e', 5001) || '"' end,
  case when p_partkey % 59 = 1 then '"rank":1' end) || '}}' end"""
REQUEST_LINE = """'{' || concat_ws(',', '"displayName":"' || repeat('n', 195 + o_orderkey % 10) || '"',
  '"contactMethod":"' || case o_orderkey % 6 when 0 then 'Text' when 1 then 'Phone' when 2 then 'Fax' when 3 then ' Email' else 'Another method' end || '"',
  case when o_orderkey % 9 = 1 then '"planPreference":"Maybe"' when o_orderkey % 9 = 2 then '"planPreference":"Not sure"' end,
  case when o_orderkey % 50 = 1 then '"situation":"' || repeat('s', 5001) || '"' end,
  case o_orderkey % 7 when 0 then '"consentRequired":[true,false]' when 1 then '"consentRequired":[true]' when 2 then null when 3 then '"consentRequired":"yes"' else '"consentRequired":[true,true]' end,
  case when o_orderkey % 8 = 1 then '"consentOptional":[true,false,true]' when o_orderkey % 8 = 2 then '"consentOptional":[]' when o_orderkey % 8 = 3 then '"consentOptional":[false]' end,
  case when o_orderkey % 21 = 1 then '"other":1' end) || '}'"""
REVIEW_LINE = """'{' || concat_ws(',', case o_orderkey % 5 when 0 then '"status":"approved"' when 1 then '"status":"needs-info"' when 2 then '"status":"open"' when 3 then '"status":"closed"' end,
  case o_orderkey % 4 when 0 then '"stage":1' when 1 then '"stage":2' when 2 then '"stage":3' end,
  case o_orderkey % 6 when 0 then '"decision":" "' when 1 then '"decision":"' || repeat('d', 101) || '"' when 2 then null else '"decision":" yes "' end,
  case when o_orderkey % 10 = 1 then '"reasonCode":"' || repeat('r', 101) || '"' end, case when o_orderkey % 33 = 1 then '"notes":"' || repeat('n', 5001) || '"' end,
  case when o_orderkey % 15 = 1 then '"by":"x"' end) || '}'"""


def errors_sql(fields: dict[str, Field], partial: bool = False) -> str:
    """The SQL that says what validation.errors says, over a column `line`."""
    cases = []
    for name, f in fields.items():
        text, path = f"json_extract_string(line, '$.{name}')", f"json_type(line, '$.{name}')"
        if f.kind == "integer":
            holds = f"{path} in ('UBIGINT', 'BIGINT') and try_cast({text} as bigint) between {f.low} and {f.high}"
        elif f.kind == "moment":
            holds = f"{path} = 'VARCHAR' and regexp_matches({text}, '{validation.MOMENT}')"
        elif f.kind == "flag":
            holds = f"{path} = 'BOOLEAN'"
        elif f.kind == "flags":
            holds = f"{path} = 'ARRAY' and json_array_length(line, '$.{name}') between {f.low} and {f.high}" + (f" and not contains({text}, 'false')" if f.all_true else "")
        else:
            holds = f"{path} = 'VARCHAR' and " + (f"{text} in ({', '.join(repr(v) for v in f.values)})" if f.values else f"length(trim({text})) between {f.low} and {f.high}")
        cases.append(f"case when {path} is null then {'null' if partial or not f.required else repr(name)} when {path} = 'NULL' then {'null' if f.nullable else repr(name)} "
                     f"when not ({holds}) then '{name}' end")
    names = ", ".join(repr(n) for n in fields)
    cases.append(f"case when len(list_filter(json_keys(line), lambda k: k not in ({names}))) > 0 then 'unknown keys' end")
    return f"case when json_type(line) <> 'OBJECT' then 'not an object' else coalesce(array_to_string([{', '.join(cases)}], ','), '') end"


def judged(spark: SparkSession, sf_dir: str, source: str, key: str, line: str, fields: dict[str, Field], partial: bool = False) -> DataFrame:
    """Every line of a source with the rules that it breaks."""
    rows = spread(table(spark, sf_dir, source)).select(F.col(key).alias("id"), F.expr(line).alias("line"))
    return rows.withColumn("errors", F.array_join(validation.errors(F.col("line"), fields, partial), ","))


def judged_sql(source: str, key: str, line: str, fields: dict[str, Field], partial: bool = False) -> str:
    lines = f"select id, case when json_valid(said) then said else '[]' end as line from (select {key} as id, {line} as said from {source})"
    return f"select id, line, {errors_sql(fields, partial)} as errors from ({lines})"


@query(f"select id, errors from ({judged_sql('part', 'p_partkey', RECORD_LINE, RECORD)})")
def import_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records by all 14 field rules, with what each breaks (empty: accepted)."""
    return judged(spark, sf_dir, "part", "p_partkey", RECORD_LINE, RECORD).select("id", "errors")


@query(f"select id, errors from ({judged_sql('part', 'p_partkey', RECORD_LINE, RECORD, True)})")
def update_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as partial updates: what is left out breaks no rule."""
    return judged(spark, sf_dir, "part", "p_partkey", RECORD_LINE, RECORD, True).select("id", "errors")


@query(f"select id, errors from ({judged_sql('orders', 'o_orderkey', REQUEST_LINE, REQUEST)})")
def request_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, "orders", "o_orderkey", REQUEST_LINE, REQUEST).select("id", "errors")


@query(f"select id, errors from ({judged_sql('orders', 'o_orderkey', REVIEW_LINE, REVIEW)})")
def review_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir, "orders", "o_orderkey", REVIEW_LINE, REVIEW).select("id", "errors")


NAME_SQL = "nullif(trim(json_extract_string(line, '$.name')), '')"
#: Parts are dealt into imports of twenty lines; some have a bad line, a wrong number of rows, a data set that is known or comes again, or replace without saying so twice.
LINES = 20
IMPORT_LINE = f"""'{{' || concat_ws(',', case when (p_partkey // 20) % 7 = 3 and p_partkey % 20 = 11 then '"name":"  "' else '"name":" ' || p_name || '  x "' end,
  '"category":"{SLUGS[7]}"', case when p_partkey % 3 = 0 then '"phoneRaw":"office 602-555-' || lpad((p_partkey % 10000)::varchar, 4, '0') || ' or 1-888-HELPNOW"' when p_partkey % 3 = 1 then '"phoneRaw":"none"' end,
  case when p_partkey % 4 = 0 then '"email":" Info@P' || p_partkey || '.org "' when p_partkey % 4 = 1 then '"email":"nobody"' end,
  case when p_partkey % 5 = 0 then '"website":"Example' || p_partkey || '.ORG/a"' when p_partkey % 5 = 1 then '"website":null' end,
  case when p_partkey % 6 = 0 then '"description":"SSN 123-45-6789, ask on upwork **now**"' when p_partkey % 6 = 1 then '"description":" "' end,
  case when p_partkey % 9 = 0 then '"id":"part-' || p_partkey || '"' end, case when p_partkey % 11 = 0 then '"piipassNotes":"by hand"' end, case when p_partkey % 13 = 0 then '"phoneNormalized":"6025550100"' end,
  case when (p_partkey // 20) % 17 = 5 and p_partkey % 20 = 3 then '"createdAt":"2026-13-01T00:00:00Z"' when p_partkey % 20 = 4 then '"createdAt":"2026-08-09T12:30Z"' end,
  case when p_partkey % 8 = 0 then '"priority":' || (p_partkey % 10) end, case when p_partkey % 7 = 0 then '"verified":true' end, case when p_partkey % 2 = 0 then '"published":true' end) || '}}'"""
KNOWN_SET = ("dataset 3", LINES)
ENVELOPE = f"""select k as import_id, k as sequence, case when k % 10 = 4 then 'replace' when k % 29 = 28 then 'merge' else 'append' end as mode, k % 20 = 4 as confirmed,
  case when k % 3 = 0 then sha256('dataset ' || (k // 6)) end as dataset, case when k % 3 = 0 then n + case when k % 9 = 6 then 1 else 0 end end as rows from (select p_partkey // {LINES} as k, count(*) as n from part group by all)"""
STORED_SQL = "select s_suppkey::varchar as id, s_name as name, 0 as priority from supplier"
EXAMPLE_SITE = "case when json_extract_string(line, '$.website') is not null then 'https://' || replace(lower(json_extract_string(line, '$.website')), '/a', '') || '/a' end"
DIRECTORY = f"""with lines as (select id, id // {LINES} as import_id, line, errors from ({judged_sql('part', 'p_partkey', IMPORT_LINE, IMPORT)})),
envelopes as ({ENVELOPE}),
found as (select e.*, n, case when bad then 'line ' || bad_id || ': ' || bad_errors end as first from envelopes e
  join (select import_id, count(*) as n, bool_or(errors <> '') as bad, min(id) filter (errors <> '') as bad_id, arg_min(errors, id) filter (errors <> '') as bad_errors from lines group by import_id) using (import_id)),
judged as (select *, case when first is not null or n > {imports.MOST_RECORDS} or mode not in ('append', 'replace') then '{imports.INVALID}' when rows <> n then '{imports.MISMATCH}'
    when dataset = sha256('{KNOWN_SET[0]}') and n = {KNOWN_SET[1]} then '{imports.KNOWN}' when mode = 'replace' and not confirmed then '{imports.UNCONFIRMED}' else '{imports.OK}' end as o from found),
decided as (select *, case when o = '{imports.OK}' and dataset is not null and row_number() over (partition by dataset, n, o order by sequence) > 1 then '{imports.KNOWN}' else o end as outcome from judged),
eras as (select *, case when outcome = '{imports.OK}' then n else 0 end as inserted, (sum((outcome = '{imports.OK}' and mode = 'replace')::int) over (order by sequence))::int as era from decided),
log as (select eras.*, case when outcome = '{imports.OK}' and mode = 'replace' then coalesce((select sum(inserted) from eras x where x.era = eras.era - 1), 0) + case when era = 1 then (select count(*) from supplier) else 0 end else 0 end::bigint as removed from eras)"""


def _imported(spark: SparkSession, sf_dir: str) -> imports.Directory:
    """A directory of suppliers after the imports, in two goes: the second half finds the first one's log."""
    parts, sets = table(spark, sf_dir, "part"), F.col("k") % 3 == 0
    number = F.col("p_partkey") - F.col("p_partkey") % LINES
    lines = spread(parts).select((number / LINES).cast("long").alias("import_id"), F.col("p_partkey").alias("place"), F.expr(IMPORT_LINE.replace("(p_partkey // 20)", "(p_partkey div 20)").replace("::varchar", "::string")).alias("line"))
    k = F.col("k")
    envelopes = lines.groupBy(F.col("import_id").alias("k")).agg(F.count(F.lit(1)).alias("n")).select(
        k.alias("import_id"), k.alias("sequence"), F.when(k % 10 == 4, "replace").when(k % 29 == 28, "merge").otherwise("append").alias("mode"), (k % 20 == 4).alias("confirmed"),
        F.when(sets, F.sha2(F.concat(F.lit("dataset "), F.floor(k / 6).cast("string")), 256)).alias("dataset"), F.when(sets, F.col("n") + F.when(k % 9 == 6, 1).otherwise(0)).alias("rows"))
    nothing = {c: F.lit(None).cast("string") for c in ("phone_raw", "phones", "email", "website", "description", "notes", "dataset")}
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.lit(SLUGS[0]).alias("category"), F.lit("").alias("tags"),
                                                     F.lit(0).alias("priority"), F.lit(False).alias("verified"), F.lit(True).alias("published"), F.lit(None).cast("long").alias("import_id")).withColumns(nothing)
    directory = imports.Directory(spark, shared_folder(spark))
    directory.start(stored)
    half = (envelopes.agg(F.max("sequence")).first()[0] or 0) // 2
    known = spark.createDataFrame([(hashlib.sha256(KNOWN_SET[0].encode()).hexdigest(), KNOWN_SET[1])], "dataset string, rows long")
    for some in (F.col("import_id") <= half, F.col("import_id") > half):
        directory.apply(envelopes.where(some), lines.where(some), IMPORT, known)
    return directory


@query(DIRECTORY + f""" select import_id, outcome, case when outcome = '{imports.INVALID}' then coalesce(first, 'mode') end as problem, inserted, removed,
  case when outcome = '{imports.OK}' then case when mode = 'replace' then 'bulk-replace' else 'bulk-import' end end as action,
  case when outcome = '{imports.OK}' then case when mode = 'replace' then 'Replaced ' || removed || ' resource(s) with ' || inserted || ' validated resource(s)' else 'Imported ' || inserted || ' validated resource(s)' end end as summary,
  case when outcome = '{imports.OK}' then '{{"mode":"' || mode || '","removed":' || removed || ',"inserted":' || inserted || coalesce(',"dataset":{{"sha256":"' || dataset || '","rowCount":' || rows || '}}', '') || '}}' end as details from log""")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each import, with the audit rows of the accepted ones: all lines or none."""
    return _imported(spark, sf_dir).log().select("import_id", "outcome", "problem", "inserted", "removed", "action", "summary", "details")


@query(DIRECTORY + f""", live as (select lines.*, dataset, trim(json_extract_string(line, '$.phoneRaw')) as phone_raw, trim(json_extract_string(line, '$.email')) as email, {EXAMPLE_SITE} as site, trim(json_extract_string(line, '$.website')) as website,
    trim(json_extract_string(line, '$.name')) as name, trim(json_extract_string(line, '$.description')) as description from lines join log using (import_id) where outcome = '{imports.OK}' and era = (select max(era) from log)),
fresh as (select *, {squash_sql('name')} as new_name, nullif(array_to_string({fill(FIRSTS, fill(PHONES_SQL, 'phone_raw'))}, ' | '), '') as new_phones, {fill(EMAIL_SQL, 'email')} as new_email, {redact_sql('description')} as redacted from live),
noted as (select *, [case when phone_raw = '' then null when new_phones is not null then 'Phone normalized' when phone_raw is not null then 'Phone could not be parsed' end,
    case when new_email is null and email is not null then 'Email invalid and dropped' when new_email <> email then 'Email normalized' end, case when site <> website then 'Website normalized' end,
    case when new_name <> name then 'Name whitespace normalized' end, {', '.join(pattern_count(n, k, 'description') for k, (n, _, _) in enumerate(privacy.REDACTIONS))}, {fill(SPAM_NOTES_SQL, 'redacted')}] as changes from fresh)
select coalesce(json_extract_string(line, '$.id'), import_id || '-' || id) as id, new_name as name, coalesce(json_extract_string(line, '$.phoneNormalized'), new_phones) as phones, new_email as email, site as website,
  nullif({clean_sql('redacted')}, '') as description, coalesce((json_extract_string(line, '$.priority'))::int, 0) as priority, coalesce((json_extract_string(line, '$.published'))::boolean, false) as published,
  coalesce(json_extract_string(line, '$.piipassNotes'), nullif(array_to_string(changes, ' | '), ''), 'no changes') as notes, dataset from noted
union all select id, name, null, null, null, null, priority, true, null, null from ({STORED_SQL}) where (select max(era) from log) = 0""")
def import_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory after all imports, normalised, with the notes of what was changed."""
    return _imported(spark, sf_dir).records().select("id", "name", "phones", "email", "website", "description", "priority", "published", "notes", "dataset")


@query(f"""with j as ({judged_sql('part', 'p_partkey', RECORD_LINE, RECORD, True)}),
n as (select p_partkey as id, p_name as name, p_size as priority, coalesce({NAME_SQL}, p_name) as new_name, coalesce(try_cast(json_extract_string(line, '$.priority') as int), p_size) as new_priority
  from part join j on id = p_partkey where errors = ''),
d as (select *, array_to_string([case when name <> new_name then 'name' end, case when priority <> new_priority then 'priority' end], ',') as changed from n)
select id, new_name as name, new_priority as priority, timestamp '2026-08-09 12:00:00' as updated_at, 'update' as action, 'Update ' || new_name as summary, changed from d where changed <> ''""")
def update_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted updates that change a record: its new values, when it was changed, and the audit row."""
    lines = judged(spark, sf_dir, "part", "p_partkey", RECORD_LINE, RECORD, True).where("errors = ''").withColumn("v", F.parse_json("line"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("old_name"), F.col("p_size").alias("old_priority")).join(lines, "id")
    name = F.coalesce(F.trim(F.variant_get("v", "$.name", "string")), "old_name")
    rows = rows.select("id", name.alias("name"), F.coalesce(F.variant_get("v", "$.priority", "int"), "old_priority").alias("priority"), "old_name", "old_priority")
    changed = F.concat_ws(",", F.when(F.col("name") != F.col("old_name"), "name"), F.when(F.col("priority") != F.col("old_priority"), "priority"))
    return rows.withColumn("changed", changed).where("changed <> ''").select(
        "id", "name", "priority", F.lit("2026-08-09 12:00:00").cast("timestamp_ntz").alias("updated_at"), F.lit("update").alias("action"),
        F.concat(F.lit("Update "), "name").alias("summary"), "changed")
