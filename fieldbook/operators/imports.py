"""Bulk imports: validated line by line, decided as a whole, applied with their audit rows and published at once.

An import is an envelope (how it is to be applied, and what data set it says it is) and its lines.  All lines are read and
checked once, and what they give is staged; one aggregate over the staged lines decides each import.  One bad line refuses
an import, replacing needs a confirmation, and a data set that is known is passed over.  Records and audit rows are written
beside what is there, and one manifest publishes both: readers see the directory and its log as before, or both as after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from fieldbook.operators import records, validation
from fieldbook.sources.published import Manifest

#: fixed value: the most records of an import
MOST_RECORDS = 1000
#: Outcomes of an import, in the order in which they are looked for.
INVALID, MISMATCH, KNOWN, UNCONFIRMED, OK = "VALIDATION_ERROR", "DATASET_COUNT_MISMATCH", "KNOWN", "REPLACE_CONFIRMATION_REQUIRED", "OK"
#: The columns of the directory.
COLUMNS = ("id", "name", "category", "phone_raw", "phones", "email", "website", "description", "tags", "priority", "verified", "published", "notes", "dataset", "import_id")


def checked(lines: DataFrame, fields: dict[str, validation.Field]) -> DataFrame:
    """lines (import_id, place, line) with `errors` (the rules it breaks), and the normalised record of each."""
    parsed = lines.withColumn("errors", validation.errors(F.col("line"), fields)).withColumn("v", F.try_parse_json("line"))
    text = lambda name: F.trim(F.try_variant_get("v", f"$.{name}", "string"))
    flag = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "boolean"), F.lit(False))
    raw = parsed.select(
        "import_id", "place", "errors", text("id").alias("id"), text("name").alias("name"), text("category").alias("category"), text("phoneRaw").alias("phone_raw"),
        text("phoneNormalized").alias("given_phones"), text("email").alias("email"), text("website").alias("website"), text("description").alias("description"),
        F.coalesce(text("tags"), F.lit("")).alias("tags"), F.coalesce(F.try_variant_get("v", "$.priority", "int"), F.lit(0)).alias("priority"), flag("verified").alias("verified"),
        flag("published").alias("published"), text("piipassNotes").alias("given_notes"), text("sourceDatasetHash").alias("given_dataset"))
    fresh = records.normalize(raw)
    said = F.when(F.size("changes") > 0, F.array_join("changes", " | ")).otherwise("no changes")
    return fresh.withColumns({"phones": F.coalesce("given_phones", "phones"), "notes": F.coalesce("given_notes", said)}).drop("given_phones", "given_notes", "changes")


def decide(envelopes: DataFrame, staged: DataFrame, known: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Each import of envelopes (import_id, sequence, mode, confirmed, dataset, rows) with `n`, its first `problem` and its `outcome`.

    `known` (dataset, rows) are those imported before; of imports that name one data set the first that is otherwise
    accepted counts.  `dataset` and `rows` may be null: then nothing is compared.  One row an import is ranked in one task.
    """
    bad = F.size("errors") > 0
    found = staged.groupBy("import_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.struct("place", F.array_join("errors", ",").alias("errors")))).alias("first"))
    both = envelopes.join(found, "import_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    seen = known.select(F.lower("dataset").alias("_dataset"), F.col("rows").alias("_rows"), F.lit(True).alias("_seen")).distinct()
    both = both.withColumn("dataset", F.lower("dataset")).join(seen, (F.col("dataset") == F.col("_dataset")) & (F.col("n") == F.col("_rows")), "left")
    fine = F.col("first").isNull() & F.col("n").between(1, most) & F.coalesce(F.col("mode").isin("append", "replace"), F.lit(False))
    outcome = (F.when(~fine, INVALID).when(F.col("rows") != F.col("n"), MISMATCH).when(F.col("_seen"), KNOWN)
               .when((F.col("mode") == "replace") & ~F.coalesce("confirmed", F.lit(False)), UNCONFIRMED).otherwise(OK))
    rank = F.row_number().over(Window.partitionBy("dataset", "n", outcome).orderBy("sequence"))
    again = (outcome == OK) & F.col("dataset").isNotNull() & (rank > 1)
    problem = F.when(F.col("n") == 0, "no records").when(F.col("n") > most, "too many records").otherwise(
        F.concat(F.lit("line "), F.col("first.place").cast("string"), F.lit(": "), F.col("first.errors")))
    return both.select("import_id", "sequence", "mode", "dataset", F.col("rows"), "n", F.when(~fine, F.coalesce(problem, F.lit("mode"))).alias("problem"),
                       F.when(again, KNOWN).otherwise(outcome).alias("outcome"))


def accounted(decided: DataFrame, stored: Column) -> DataFrame:
    """decided with `era` (how many replacements there were up to it), and `removed` and `inserted` of the accepted ones.

    A replacement removes what was inserted since the one before it, the first also the `stored` rows.
    """
    order = Window.orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row an import
    replaces = (F.col("outcome") == OK) & (F.col("mode") == "replace")
    rows = decided.withColumns({"inserted": F.when(F.col("outcome") == OK, F.col("n")).otherwise(F.lit(0).cast("long")), "era": F.sum(replaces.cast("int")).over(order)})
    eras = rows.groupBy((F.col("era") + 1).alias("era")).agg(F.sum("inserted").alias("_before"))
    gone = F.coalesce("_before", F.lit(0).cast("long")) + F.when(F.col("era") == 1, stored).otherwise(F.lit(0).cast("long"))
    return rows.join(eras, "era", "left").withColumn("removed", F.when(replaces, gone).otherwise(F.lit(0).cast("long"))).drop("_before")


def audited(rows: DataFrame) -> DataFrame:
    """The accounted imports with the audit row of each accepted one (action, summary, details; null for others)."""
    done, replaced = F.col("outcome") == OK, F.col("mode") == "replace"
    count = lambda c: F.col(c).cast("string")
    summary = F.when(replaced, F.concat(F.lit("Replaced "), count("removed"), F.lit(" resource(s) with "), count("inserted"), F.lit(" validated resource(s)"))).otherwise(
        F.concat(F.lit("Imported "), count("inserted"), F.lit(" validated resource(s)")))
    details = F.to_json(F.struct("mode", "removed", "inserted", F.when(F.col("dataset").isNotNull(), F.struct(F.col("dataset").alias("sha256"), F.col("rows").alias("rowCount"))).alias("dataset")))
    return rows.withColumns({"action": F.when(done, F.when(replaced, "bulk-replace").otherwise("bulk-import")), "summary": F.when(done, summary), "details": F.when(done, details)})


class Directory:
    """The directory's records and the log of its imports under `path`, as last published."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def _table(self, name: str) -> DataFrame | None:
        said = self.manifest.current()[1]
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in said[name]]) if said and said[name] else None

    def records(self) -> DataFrame | None:
        return self._table("records")

    def log(self) -> DataFrame | None:
        """Outcomes and audit rows of all imports, refused ones included."""
        return self._table("log")

    def start(self, rows: DataFrame) -> None:
        """Publishes the first records (COLUMNS)."""
        rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/data/000000000001/records")
        self.manifest.publish(1, {"records": ["data/000000000001/records"], "log": []})

    def apply(self, envelopes: DataFrame, lines: DataFrame, fields: dict[str, validation.Field], known: DataFrame | None = None) -> None:
        """Applies imports in their sequence, all or nothing each; imports that the log accepted are known.

        The records of a version are folders of all versions since the last replacement, so an import writes its own rows alone.
        """
        version, said = self.manifest.current()
        said = said or {"records": [], "log": []}
        target = f"data/{version + 1:012d}"
        checked(lines, fields).write.mode("overwrite").parquet(f"{self.path}/{target}/staged")
        staged = self.spark.read.parquet(f"{self.path}/{target}/staged")
        before, past = self.records(), self.log()
        seen = past.where(F.col("outcome") == OK).where("dataset is not null").select("dataset", F.col("n").alias("rows")) if past is not None else None
        known = known.select("dataset", "rows") if known is not None else self.spark.createDataFrame([], "dataset string, rows long")
        stored = F.lit(before.count() if before is not None else 0).cast("long")
        decided = decide(envelopes, staged, known.union(seen) if seen is not None else known)
        audited(accounted(decided, stored)).write.mode("overwrite").parquet(f"{self.path}/{target}/log")
        log = self.spark.read.parquet(f"{self.path}/{target}/log")
        last = log.agg(F.max("era")).first()[0] or 0  # how many replacements there were
        live = log.where((F.col("outcome") == OK) & (F.col("era") == last)).select("import_id", F.col("dataset").alias("_dataset"))
        fresh_id = F.concat(F.col("import_id").cast("string"), F.lit("-"), F.col("place").cast("string"))
        rows = staged.join(live, "import_id").withColumns({"id": F.coalesce("id", fresh_id), "dataset": F.coalesce(F.col("given_dataset"), F.col("_dataset"))})
        rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/{target}/records")
        kept = said["records"] if not last else []
        self.manifest.publish(version + 1, {"records": [*kept, f"{target}/records"], "log": [*said["log"], f"{target}/log"]})
        self.manifest.clean()
