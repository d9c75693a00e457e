"""Date functions as Column expressions; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(x: Column) -> Column:
    """Timestamp of an ISO text, a Z or an offset allowed, or a date alone; null where it is neither."""
    return F.coalesce(F.try_to_timestamp(x), F.try_to_timestamp(F.substring(x, 1, 10), F.lit("yyyy-MM-dd")))


def parse_rfc2822(x: Column) -> Column:
    """Timestamp of a mail-style date; the weekday is dropped first, as it can't be parsed."""
    bare = F.regexp_replace(x, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))


def day_gap(a: Column, b: Column) -> Column:
    """Whole days from b to a, rounded down also below zero."""
    return F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 3600


def date_similarity(a: Column, b: Column, reach: int = 14) -> Column:
    """1 at the same time, 0 from `reach` days on, null if either is not known."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400 / reach)


def attack_date(text: Column) -> Column:
    """The first valid date: ISO first, then day/month/year or day-month-year, then month/day/year."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{1,2}-\d{1,2})\b"), 1), lambda d: F.try_to_date(d, "yyyy-M-d"))
    other = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b"), 1), lambda d: F.replace(d, F.lit("-"), F.lit("/")))
    both = F.transform(other, lambda d: F.coalesce(F.try_to_date(d, "d/M/yyyy"), F.try_to_date(d, "M/d/yyyy")))
    return F.get(F.array_compact(F.concat(iso, both)), F.lit(0))


def week_index(age_days: Column, weeks: int = 8) -> Column:
    """0 for the oldest of the last `weeks` weeks up to weeks - 1 for the newest."""
    return (weeks - 1) - F.least(F.lit(weeks - 1), F.floor(age_days / 7))
