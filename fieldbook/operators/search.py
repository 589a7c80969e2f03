"""Weighted fuzzy search: a score column per row, matched fields, ranking and paging.

The query's tokens are few and known when the plan is built, so the score is one sum of expressions over the fields: one
pass over the rows, no join and no Python.  Only fields that do not contain a token as text are cut into words for the
fuzzy comparison, and only words of nearly its length are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


# fixed values: words a query does not search for, and the weight of each field
STOPWORDS = frozenset("the and for of to a an in on at by with or is are be as from that this it its".split())
WEIGHTS = {"name": 5.0, "acronym": 8.0, "tags": 4.0, "description": 2.0, "category": 3.0, "subcategory": 2.0, "address": 1.5, "phone_raw": 3.0,
           "phone_normalized": 3.0, "email": 2.0, "website": 2.0, "source_note": 1.5}


def parameters(q: str = "", limit: int = 24, offset: int = 0, most: int = 1000) -> tuple[str, int, int]:
    """Checked parameters of a search: at most 200 characters, 1 to `most` rows (100 for administrators), an offset up to 100,000."""
    q = q.strip()
    if len(q) > 200:
        raise ValueError("a query has 200 characters at most")
    if not 1 <= limit <= most:
        raise ValueError(f"limit is 1 to {most}")
    if not 0 <= offset <= 100_000:
        raise ValueError("offset is 0 to 100000")
    return q, limit, offset


def query_tokens(query: str) -> list[str]:
    """Tokens of a query that count; one that is said twice counts twice."""
    words = re.sub(r"[^a-z0-9\s]", " ", query.lower()).split()
    return [w for w in words if w not in STOPWORDS and len(w) > 1]


def tokens(text: Column) -> Column:
    """The runs of letters and digits: all other characters part words, as white space does."""
    words = F.split(F.lower(text), "[^abcdefghijklmnopqrstuvwxyz0123456789]+")  # said one by one they are a table, as ranges a chain of comparisons
    return F.filter(words, lambda w: w != "")


def token_score(field: str, text: Column, words: Column, token: str) -> Column:
    """Score of one token in one field of distinct words: acronym, substring (more at the start of a word) or nearest word."""
    weight, lower = WEIGHTS[field], F.lower(text)
    tolerance = 1 if len(token) <= 4 else 2
    near = F.filter(words, lambda w: F.abs(F.length(w) - len(token)) <= 2)
    distances = F.filter(F.transform(near, lambda w: F.levenshtein(w, F.lit(token), tolerance)), lambda d: d >= 0)
    fuzzy = F.coalesce((2 - F.array_min(distances) * 0.6) * weight, F.lit(0.0))
    # a plain search is far cheaper than the pattern, and most texts have not the token
    inside = F.when(lower.rlike(f"(?<![A-Za-z0-9_]){token}"), F.lit(4 * weight)).otherwise(F.lit(2.5 * weight))
    hit = F.when(lower.contains(token), inside).otherwise(fuzzy)
    if field == "acronym":
        hit = F.when(lower == token, F.lit(12 * weight)).otherwise(hit)
    return F.coalesce(hit, F.lit(0.0))


def score(rows: DataFrame, query: str) -> DataFrame:
    """rows with `score` (6 decimals) and `matched`, the fields hit; fields are the columns of rows that have a weight."""
    words = query_tokens(query)
    fields = [f for f in WEIGHTS if f in rows.columns]
    rows = rows.withColumns({f"_words_{f}": F.array_distinct(tokens(F.col(f))) for f in fields})  # cut once for all tokens
    sums = {f: sum((token_score(f, F.col(f), F.col(f"_words_{f}"), w) for w in words), F.lit(0.0)) for f in fields}
    rows = rows.withColumns({f"_{f}": s for f, s in sums.items()})
    total = sum((F.col(f"_{f}") for f in fields), F.lit(0.0))
    boost = F.when(F.col("priority") >= 1, F.lit(1.15)).otherwise(F.lit(1.0))
    matched = F.array_compact(F.array(*[F.when(F.col(f"_{f}") > 0, F.lit(f)) for f in fields]))
    return rows.withColumns({"score": F.round(total * boost, 6), "matched": matched}).drop(*[f"_{f}" for f in fields], *[f"_words_{f}" for f in fields])


def search(rows: DataFrame, query: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the ranking; a query without tokens is all rows by name.

    Rows that score nothing rank last, so they are dropped after paging: a filter before it would be pushed below the
    projections, and the words of every field would be cut again for each token.
    """
    if not query_tokens(query):
        ordered = rows.withColumns({"score": F.lit(0.0), "matched": F.array().cast("array<string>")}).orderBy(F.collate("name", "UNICODE"), "id")
        return ordered.offset(offset).limit(limit)
    ordered = score(rows, query).orderBy(F.col("score").desc(), F.col("priority").desc(), F.collate("name", "UNICODE"), "id")
    return ordered.offset(offset).limit(limit).where("score > 0")


def highlight(text: Column, query: str) -> Column:
    """The query's words of two letters or more inside <mark>, longest first."""
    words = sorted({w for w in re.split("[^a-z0-9]+", query.lower()) if len(w) > 1}, key=lambda w: (-len(w), w))
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else text
