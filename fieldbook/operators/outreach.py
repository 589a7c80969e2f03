"""Weekly buckets, streaks, follow-ups and small models; today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: streak milestones, share of grants and size of one
MILESTONES = (4, 8, 12, 16, 20, 26, 52)
ALLOCATED, GRANT = 0.85, 15000


def week(day: Column, today: Column) -> Column:
    """0 for the seven days that end today, 1 for the seven before, and so on; negative in the future."""
    return F.floor(F.datediff(today, day) / 7)


def weekly(entries: DataFrame, day: str, today: Column, n_weeks: int = 8) -> DataFrame:
    """bucket (0 is the oldest), begins and n of the last weeks, zero-filled."""
    counts = entries.select(week(F.col(day), today).alias("_w")).where(F.col("_w").between(0, n_weeks - 1)).groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    weeks = entries.sparkSession.range(n_weeks)
    return weeks.join(F.broadcast(counts), F.col("id") == F.col("_w"), "left").select(  # one row per week
        (n_weeks - 1 - F.col("id")).alias("bucket"), F.date_sub(today, (F.col("id") * 7 + 6).cast("int")).alias("begins"), F.coalesce("_n", F.lit(0)).alias("n"))


def weeks_of(entries: DataFrame, key: str, day: str, today: Column, n_weeks: int = 8) -> DataFrame:
    """key and weeks: numbers of entries by week, this week first; counted before the shuffle."""
    w = week(F.col(day), today)
    counts = entries.where(w.between(0, n_weeks - 1)).groupBy(key).agg(*[F.count_if(w == i).alias(f"_{i}") for i in range(n_weeks)])
    return counts.select(key, F.array(*[f"_{i}" for i in range(n_weeks)]).alias("weeks"))


def streak(weeks: Column) -> Column:
    """Length of the latest run of weeks that are not empty, this week first; empty weeks before it are passed over."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("over"))
    step = lambda s, x: F.struct(F.when(~s["over"] & (x > 0), s["n"] + 1).otherwise(s["n"]).alias("n"), (s["over"] | ((x == 0) & (s["n"] > 0))).alias("over"))
    return F.aggregate(weeks, start, step, lambda s: s["n"])


def age(days: Column) -> Column:
    text = days.cast("string")
    return (F.when(days <= 0, "today").when(days == 1, "1 day ago").when(days < 30, F.concat(text, F.lit(" days ago")))
            .otherwise(F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago"))))


def follow_up(last: Column, now: Column, mode: str) -> Column:
    """Whether the last contact is more than seven days ago: `fractional` from its midnight to now, `whole_day` in whole days."""
    if mode == "whole_day":
        return F.datediff(now, last) > 7
    return (F.unix_micros(now) - F.unix_micros(last.cast("timestamp"))) > 7 * 86_400_000_000


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), rounded(x)))


def fund(people: Column, monthly: Column) -> list[Column]:
    annual = people * monthly * 12
    return [rounded(annual).alias("annual"), rounded(rounded(annual) * ALLOCATED).alias("allocation"), rounded(annual * ALLOCATED / GRANT).alias("modeled")]


def day_hash(day: str) -> int:
    """Signed 32-bit hash of a text: 31 times the hash so far, plus the character."""
    h = 0
    for c in day:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h
