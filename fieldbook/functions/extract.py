"""Records and categories found in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldbook.functions.patterns import java
from fieldbook.functions.text import blank_to_null, strip

# fixed values: first contacts of a text, and the categories by their words in order
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)\b(?:https?:\/\/|www\.)[^\s<>]+"
PHONE = (r"(?i)(?:\+?1[\s./-]*)?(?:\(?\d{3}\)?[\s./-]*)\d{3}[\s./-]*\d{4}(?:\s*(?:x|ext\.?|extension)\s*\d+)?"
         r"|\b1[\s-]*800[\s-]*[A-Z0-9-]{7,}\b")
CATEGORY_RULES = (
    ("child-abduction", r"child abduction|missing child|custodial interference|kidnapp"),
    ("victim-rights-compensation", r"victim rights|victim compensation|crime victim"),
    ("domestic-violence-family-violence", r"domestic violence|family violence|child abuse|shelter"),
    ("family-advocacy-trauma-recovery", r"trauma recovery|family advocacy|advocacy center"),
    ("protective-parent-family-court", r"protective parent|family court abuse"),
    ("gaslighting-darvo-institutional-betrayal", r"darvo|gaslighting|institutional betrayal|coercive control"),
    ("parental-alienation-fathers-rights", r"parental alienation|father'?s rights|equal parenting"),
    ("legal-aid-court-access", r"legal aid|court access|pro bono"),
    ("attorneys-firms", r"law firm|attorney|lawyer"),
    ("disability-medical-advocacy", r"disability rights|patient advocacy|medical gaslighting"),
    ("lyme-co-infections", r"lyme|babesia|co-infection"),
    ("housing-financial-aid", r"housing|rental assistance|financial aid|grant|food assistance"),
)


def first(text: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(text, java(pattern), 0))


def records(rows: DataFrame, text: str) -> DataFrame:
    """rows with email, link, phone_raw, name and description; lines that hold a contact are neither name nor description.

    Contacts are columns of their own before lines are looked at, so that each pattern runs once per text.
    """
    lines = F.filter(F.transform(F.split(text, "\r?\n"), strip), lambda line: line != "")
    rows = rows.withColumns({"_email": first(F.col(text), EMAIL), "_link": first(F.col(text), URL), "_phone": strip(first(F.col(text), PHONE)), "_lines": lines})
    email, link, phone, lines = (F.col(c) for c in ("_email", "_link", "_phone", "_lines"))
    holds = lambda line, found: F.coalesce(line.contains(found), F.lit(False))
    content = F.filter(lines, lambda line: ~(holds(line, email) | holds(line, link) | holds(line, phone)))
    rows, content = rows.withColumn("_content", content), F.col("_content")
    rest = F.slice(content, F.lit(2), F.greatest(F.size(content) - 1, F.lit(0)))
    name = F.coalesce(F.try_element_at(content, F.lit(1)), F.try_element_at(lines, F.lit(1)))
    return rows.withColumns({"email": email, "link": F.regexp_replace(link, "[),.;]+$", ""), "phone_raw": phone, "name": name,
                             "description": F.array_join(rest, "\n")}).drop("_email", "_link", "_phone", "_lines", "_content")


def category(text: Column) -> Column:
    """The first category whose words occur, or null."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + java(pattern)), F.lit(slug)) for slug, pattern in CATEGORY_RULES])
