"""Normalisation of contact data and prose: every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from fieldbook.functions.patterns import BLANKS, FOLDED, java

# fixed values: telephone keypad, words that are no part of a number, what separates numbers, a valid address
KEYPAD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
ANNOTATIONS = ("voice", "text", "fax", "tty", "phoenix", "tucson", "maricopa", "office", "main", "hotline", "crisis", "intake",
               "cell", "home", "work")
SEPARATORS = r"(?i)[;/,]|\bor\b|\band\b"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
# fixed values: the steps of artifact cleaning, in order, as (pattern, replacement)
ARTIFACTS = (
    (r"【\d+†L\d+-L\d+】", ""),
    (r"\[L\d+-?L?\d*\]", ""),
    (r"(?m)^[=\-_*~]{4,}$", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\s+\*\*([^*]+)\*\*", " $1"),
    (r"^\*+\s*", ""),
    (r"\*\*", ""),
    (r"(?<!\*)\*(?!\*)", ""),
    (r"(?m)^[-•]\s+", ""),
    (r"(?m)^[ \t]+|[ \t]+$", ""),
    (r"\n{3,}", "\n\n"),
)
#: What a text has to contain for each of these steps to change it; "" where nothing plain is needed.  The last two steps
#: only take out white space next to other white space or at an end, which folding it afterwards does as well.
NEEDS = ("【", "[L", "", "#", "**", "*", "**", "*", "")
#: What a match of each of these steps begins with, as in a bracket.
STARTS = ("【", r"\[", r"=\-_*~", "#", "^!-~", "*", "*", "*", "-•")
# fixed values: tags that are bookkeeping, not for readers
INTERNAL_TAGS = r"(?i)^master_extract$|^deduplicated|^ri-\d+|^final_|^source:|^validation:"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f mentions it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def blank_to_null(text: Column) -> Column:
    return once(text, lambda t: F.when(t != "", t))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def squash(text: Column) -> Column:
    """Runs of white space become one space; nothing left is null."""
    return blank_to_null(F.trim(F.regexp_replace(text, FOLDED, " ")))


def clean_artifacts(text: Column) -> Column:
    """Prose without citation marks, separator lines and stray Markdown; null if nothing is left.

    A step is passed over where a text has not the plain part (`NEEDS`) of what it looks for.
    """
    for (pattern, replacement), need, first in zip(ARTIFACTS, NEEDS, STARTS):
        text = once(text, lambda t, p=java(pattern, first), r=replacement, n=need: F.when(t.contains(n), F.regexp_replace(t, p, r)).otherwise(t) if n else F.regexp_replace(t, p, r))
    return squash(text)


def phones(raw: Column) -> Column:
    """All 7- and 10-digit numbers of a text in order, each once; letters count as keypad digits.

    Every step is one pass over the whole text; only what has a number's length is cut out and turned into digits.
    """
    initials = "".join(sorted({a[0] for a in ANNOTATIONS}))
    bare = F.regexp_replace(raw, java(r"(?i)\b(?:" + "|".join(ANNOTATIONS) + r")\b", initials), " ")
    parted = F.regexp_replace(bare, java(r"(?i)\b(?:or|and)\b", "ao"), ";")
    keys = F.split(F.regexp_replace(F.upper(parted), f"[^{KEYPAD[0]}0123456789;/,]+", ""), "[;/,]")  # characters said one by one are a table, ranges a chain of comparisons
    long = F.filter(keys, lambda s: F.length(s).isin(7, 10) | ((F.length(s) == 11) & s.startswith("1")))
    digits = F.transform(long, lambda s: F.translate(F.when(F.length(s) == 11, F.substring(s, 2, 10)).otherwise(s), *KEYPAD))
    return F.array_distinct(digits)


def phone(raw: Column) -> Column:
    return F.try_element_at(phones(raw), F.lit(1))


def phone_display(number: Column) -> Column:
    """(AAA) BBB-CCCC or BBB-CCCC; any other length as it is, empty as null."""
    part = lambda a, n: F.substring(number, a, n)
    return (F.when(F.length(number) == 10, F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4)))
            .when(F.length(number) == 7, F.concat(part(1, 3), F.lit("-"), part(4, 4))).otherwise(blank_to_null(number)))


def email(raw: Column) -> Column:
    """Lower-case address from the first two parts at an @ sign; null if it is none."""
    parts = F.split(F.lower(strip(F.when(raw.contains("@"), raw))), "@")  # most texts have none
    local, domain = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    whole = F.concat(strip(local), F.lit("@"), strip(domain))
    return F.when((local != "") & (domain != "") & whole.rlike(java(EMAIL)), whole)


def truncate(text: Column, most: int, keep: int | None = None) -> Column:
    """At most `most` characters: a longer text is cut to `keep` (most - 1) and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep or most - 1)), F.lit("…"))).otherwise(text)


def slug(text: Column, most: int = 40, default: str = "collection") -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(F.left(dashed, F.lit(most))), F.lit(default))


def label(text: Column) -> Column:
    """needs-info as Needs Info; letters other than each word's first stay as they are."""
    words = F.transform(F.split(text, "-"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(words, " ")


def tags(text: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")


def visible_tags(text: Column) -> Column:
    return F.filter(tags(text), lambda t: ~t.rlike(INTERNAL_TAGS))
