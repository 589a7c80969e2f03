"""Validation of JSON lines by tables of field rules; every rule is a column expression, so a line is checked in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fieldbook.functions.text import once, strip


#: A time in UTC; seconds may be left out.
MOMENT = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?Z$"


@dataclass(frozen=True)
class Field:
    """A field's kind (text, integer, flag, flags or moment), bounds of its trimmed length, value or size, and whether it may be left out or null."""

    kind: str = "text"
    low: int = 0
    high: int = 0
    required: bool = False
    nullable: bool = False
    values: tuple[str, ...] = ()
    all_true: bool = False


def _holds(line: Column, name: str, field: Field) -> Column:
    path = f"$.{name}"
    kind = F.schema_of_variant(F.variant_get(line, path, "variant"))
    if field.kind == "integer":
        return (kind == "BIGINT") & F.try_variant_get(line, path, "bigint").between(field.low, field.high)
    if field.kind == "flag":
        return kind == "BOOLEAN"
    if field.kind == "moment":
        return (kind == "STRING") & F.try_variant_get(line, path, "string").rlike(MOMENT)
    if field.kind == "flags":
        flags = F.try_variant_get(line, path, "array<boolean>")
        some = kind.isin("ARRAY<BOOLEAN>", "ARRAY<VOID>") & F.size(flags).between(field.low, field.high)
        return some & F.forall(flags, lambda x: x) if field.all_true else some
    text = F.try_variant_get(line, path, "string")
    return (kind == "STRING") & (text.isin(*field.values) if field.values else F.length(strip(text)).between(field.low, field.high))


def errors(line: Column, fields: dict[str, Field], partial: bool = False) -> Column:
    """Names of the fields that break their rule, in order; `unknown keys` if there are others, `not an object` if it is none.

    In a partial line every field may be left out.
    """
    # each line is parsed once, whatever the number of fields
    whole = F.struct(F.try_parse_json(line).alias("parsed"), F.json_object_keys(line).alias("keys"))
    return once(whole, lambda x: _errors(x["parsed"], x["keys"], fields, partial))


def _errors(parsed: Column, keys: Column, fields: dict[str, Field], partial: bool) -> Column:
    found = []
    for name, field in fields.items():
        kind = F.schema_of_variant(F.variant_get(parsed, f"$.{name}", "variant"))
        fine = (F.when(kind.isNull(), F.lit(partial or not field.required)).when(kind == "VOID", F.lit(field.nullable))
                .otherwise(F.coalesce(_holds(parsed, name, field), F.lit(False))))
        found.append(F.when(~fine, F.lit(name)))
    other = F.array_except(keys, F.array(*[F.lit(n) for n in fields]))
    found.append(F.when(F.size(other) > 0, F.lit("unknown keys")))
    return F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*found)))
