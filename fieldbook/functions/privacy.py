"""Redaction of personal data and spam flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.functions.patterns import java
from fieldbook.functions.text import once

# fixed values: (what it is called, pattern, replacement), in order
REDACTIONS = (
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN REDACTED]"),
    ("DOB", r"(?i)\b(DOB|Date of Birth|born)\s*[:\-]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}-\d{2}-\d{2})\b", "$1: [DOB REDACTED]"),
    ("long-digit (possible account/card)", r"\b\d{13,19}\b", "[REDACTED]"),
)
#: What a match of each begins with, as in a bracket.
STARTS = ("0-9", "db", "0-9")
#: No redaction applies to a text without a digit on both sides of one of these, or thirteen digits in a row.
DIGITS = r"\d(?:[/\-.]\d|\d{12})"
# fixed values: text of marketplaces that is no resource
SPAM = (
    r"\bfiverr\b", r"\bupwork\b", r"\bfreelancer\.com\b", r"\bpeopleperhour\b", r"\bguru\.com\b", r"\btoptal\b", r"\bnocodedevs\b",
    r"\bmakerpad\b", r"\bworksome\b", r"\bcodemap\.io\b", r"\bkolabtree\b", r"\baijobs\.net\b", r"\bsell.*codebase\b",
    r"\bbuy\/sell.*template\b", r"\bflippa\b", r"\bgig package\b", r"\bfreelance marketplace\b", r"\bsell no-code\b",
    r"\bcommission on sales\b", r"\bsafe-pay escrow\b",
)


SPAM_NOTE = 'SPAM DETECTED: pattern "{}" found in text'


def spam(text: Column) -> Column:
    """The patterns a text matches, in order; a pattern is tried only where its longest plain part occurs."""
    return _spam(F.lower(text))


def _spam(lower: Column, said: str = "{}") -> Column:
    plain = lambda p: max(re.findall("[a-z -]+", p.replace(r"\b", "")), key=len)
    return F.array_compact(F.array(*[F.when(lower.contains(plain(p)) & lower.rlike(java(p)), F.lit(said.format(p))) for p in SPAM]))


def redact(text: Column) -> Column:
    """The text with personal data replaced; null is empty."""
    return _redacted(text)[-1]


def _redacted(text: Column) -> list[Column]:
    """The text after no, one, two ... redactions; a text without any digit is left alone."""
    steps = [F.coalesce(text, F.lit(""))]
    for (_, pattern, replacement), first in zip(REDACTIONS, STARTS):
        steps.append(once(steps[-1], lambda t, p=java(pattern, first), r=replacement: F.when(t.rlike(DIGITS), F.regexp_replace(t, p, r)).otherwise(t)))
    return steps


def redactions(text: Column) -> Column:
    """What redaction did, as notes in order."""
    notes = []
    for (name, pattern, _), left in zip(REDACTIONS, _redacted(text)):
        n = F.regexp_count(left, F.lit(java(pattern)))
        notes.append(once(n, lambda n, name=name: F.when(n > 0, F.concat(F.lit("Redacted "), n.cast("string"), F.lit(f" {name} pattern(s)")))))
    whole = F.array_compact(F.array(*notes))
    return F.when(F.coalesce(text, F.lit("")).rlike(DIGITS), whole).otherwise(F.array().cast("array<string>"))


def spam_notes(text: Column) -> Column:
    return _spam(F.lower(text), SPAM_NOTE)


def redacted(rows: DataFrame, column: str, notes: str) -> DataFrame:
    """rows with `column` redacted (null is empty) and `notes`: what redaction did, and the spam patterns in what it left.

    One scan for all redactions' patterns finds the texts that any applies to; only these are rewritten, each step once.
    """
    steps = [f"_step{i}" for i in range(len(REDACTIONS) + 1)]
    any_of = "(?=[0-9db])(?:" + "|".join(java(p.removeprefix("(?i)")) for _, p, _ in REDACTIONS) + ")"  # none begins otherwise
    rows = rows.withColumn(steps[0], F.coalesce(column, F.lit("")))
    rows = rows.withColumn("_hit", F.col(steps[0]).rlike(DIGITS) & F.col(steps[0]).rlike(f"(?i){any_of}"))
    counts = []
    for (name, pattern, replacement), first, before, after in zip(REDACTIONS, STARTS, steps, steps[1:]):
        pattern = java(pattern, first)
        rows = rows.withColumn(after, F.when(F.col("_hit"), F.regexp_replace(before, pattern, replacement)).otherwise(F.col(before)))
        n = F.when(F.col("_hit"), F.regexp_count(before, F.lit(pattern)))
        counts.append(once(n, lambda n, name=name: F.when(n > 0, F.concat(F.lit("Redacted "), n.cast("string"), F.lit(f" {name} pattern(s)")))))
    lower = rows.withColumn("_lower", F.lower(steps[-1]))  # once for all patterns
    found = _spam(F.col("_lower"), SPAM_NOTE)
    return lower.withColumns({notes: F.concat(F.array_compact(F.array(*counts)), found), column: F.col(steps[-1])}).drop(*steps, "_hit", "_lower")
