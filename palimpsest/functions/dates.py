"""Whole days, horizons, age classes and calendar windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_days(start: Column, end: Column) -> Column:
    """Full days of 86,400 seconds between two instants (DATE-1), not calendar days."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("long")


def horizon(at: Column, days: int) -> Column:
    return at + F.expr(f"INTERVAL {days} DAYS")


def age_class(days: Column, fresh: int = 7, stale: int = 30) -> Column:
    """fresh, aging or stale (DATE-3)."""
    return F.when(days < fresh, "fresh").when(days < stale, "aging").otherwise("stale")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_key(ts: Column) -> Column:
    """ISO week, such as 2026-W14 (WIN-6)."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def quarter_hour(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 900) * 900)
