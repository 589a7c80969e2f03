"""Normalisation of whole directory records, with the list of what it changed; cleaning of stored ones, with audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.functions import links, privacy, text

# fixed values: how the fields that a cleaning changes are named in its report
DIFFERENCES = (("name", "name normalized"), ("phones", "phoneNormalized changed"), ("email", "email changed"), ("website", "website changed"), ("description", "description changed"))


def _note(raw: Column, fresh: Column, what: str, lost: str, differs: bool = True) -> Column:
    """`what` normalized or `lost`, of a raw value that is there; with `differs` only if normalising changed it."""
    there = F.coalesce(raw, F.lit("")) != ""
    return F.when(there & fresh.isNull(), f"{what} {lost}").when(there & ((fresh != raw) if differs else F.lit(True)), f"{what} normalized")


def normalize(rows: DataFrame) -> DataFrame:
    """rows (name, phone_raw, email, website, description and others) with the normalised values, `phones` and `changes`.

    Personal data is redacted before artifacts are cleaned.  Each value is a column of its own before it is used twice:
    the text after each redaction serves its count, the next redaction, the spam patterns and the cleaning.
    """
    raw = {f"_{c}": F.col(c) for c in ("name", "email", "website")}
    rows = rows.withColumns({**raw, "phones": text.blank_to_null(F.array_join(text.phones(F.col("phone_raw")), " | ")), "email": text.email(F.col("email")),
                             "website": links.normalize(F.col("website")), "name": F.coalesce(text.squash(F.col("name")), F.col("name"))})
    rows = privacy.redacted(rows, "description", "_found")
    notes = F.array_compact(F.array(
        _note(F.col("phone_raw"), F.col("phones"), "Phone", "could not be parsed", False), _note(F.col("_email"), F.col("email"), "Email", "invalid and dropped"),
        _note(F.col("_website"), F.col("website"), "Website", "invalid and dropped"), F.when(~F.col("name").eqNullSafe(F.col("_name")), "Name whitespace normalized")))
    return rows.withColumns({"changes": F.concat(notes, "_found"), "description": text.clean_artifacts(F.col("description"))}).drop(*raw, "_found")


def cleanup(stored: DataFrame) -> DataFrame:
    """The report of a cleaning: every stored record (id, name, phone_raw, phones, email, website, description) with its fresh values.

    `diffs` names the fields that are stored otherwise, `changed` tells whether there are any, and `changes` has them and
    the notes of the normalisation.  Both versions come from one pass over the rows, so nothing is joined.
    """
    fields = [c for c, _ in DIFFERENCES]
    rows = normalize(stored.withColumns({f"_was_{c}": F.col(c) for c in fields}))
    diffs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_was_{c}")), F.lit(said)) for c, said in DIFFERENCES]))
    rows = rows.withColumn("diffs", diffs).withColumns({"changed": F.size("diffs") > 0, "changes": F.concat("diffs", "changes"), "was_name": F.col("_was_name")})
    return rows.drop(*[f"_was_{c}" for c in fields])


def cleanup_audit(report: DataFrame, actor: str) -> DataFrame:
    """An audit row per changed record and one of the whole pass; the changed ids are in the former, so no row grows with them."""
    each = report.where("changed").select(
        F.lit("piipass-resource").alias("action"), F.col("id").cast("string").alias("resource_id"), F.lit(actor).alias("actor"),
        F.concat(F.lit("PII cleanup updated resource: "), "was_name").alias("summary"), F.to_json(F.struct("changes")).alias("details"))
    whole = report.agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changedCount"))
    said = F.concat(F.lit("PII cleanup pass: "), F.col("changedCount").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" resource(s) updated."))
    return each.union(whole.select(F.lit("piipass"), F.lit(None).cast("string"), F.lit(actor), said, F.to_json(F.struct("total", "changedCount"))))
