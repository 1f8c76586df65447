"""Dates and times as text, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_rfc822(when: Column) -> Column:
    return F.concat(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def from_rfc822(text: Column) -> Column:
    """Any weekday; GMT, UT, Z or an offset. What isn't such a time is null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"(?i)\s+(GMT|UTC?|Z)$", " +0000")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss xx"))


def to_date_key(when: Column) -> Column:
    return F.date_format(when, "yyyyMMdd")


def to_time_key(when: Column) -> Column:
    return F.date_format(when, "HHmmss")


def from_date_key(key: Column) -> Column:
    """Midnight of a YYYYMMDD; null if it is none."""
    return F.try_to_timestamp(key, F.lit("yyyyMMdd"))


def from_time_key(key: Column) -> Column:
    """Seconds after midnight of a HHMMSS; null if it is none."""
    part = lambda i: F.substring(key, i, 2).cast("int")
    good = key.rlike(r"^([01]\d|2[0-3])[0-5]\d[0-5]\d$")
    return F.when(good, part(1) * 3600 + part(3) * 60 + part(5))


def display(when: Column, european: bool = False) -> Column:
    """A long day for Europe, else the date in order of size."""
    return F.date_format(when, "EEEE, dd MMMM yyyy HH:mm:ss xx" if european else "yyyy-MM-dd EEE HH:mm:ss xx")
