"""Dates as sites write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def parse_date(value: Column) -> Column:
    """UTC timestamp by the first pattern that fits, else by a YYYY-MM-DD prefix, else null."""
    v = F.trim(value)
    # the shape is asked first: a parser that meets another pattern's text may raise
    tries = [F.when(v.rlike(shape), F.try_to_timestamp(F.when(v.rlike(shape), F.regexp_replace(v, "^[A-Z][a-z]{2}, ", "")), F.lit(p))) for shape, p in fixed.DATE_PATTERNS]
    day = F.substring(v, 1, 10)
    prefix = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date").cast("timestamp"))
    return F.coalesce(*tries, prefix)


def is_stale(lastmod: Column, now: Column) -> Column:
    """Unparseable, not after the epoch, or more than two days after ``now``; never for null or empty."""
    d = parse_date(lastmod)
    late = d > now + F.expr(f"INTERVAL {fixed.FUTURE_DAYS} DAYS")
    return F.when(F.coalesce(lastmod, F.lit("")) == "", F.lit(False)).otherwise(d.isNull() | (d <= F.lit("1970-01-01").cast("timestamp")) | late)
