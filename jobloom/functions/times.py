"""Ages and week keys; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts))


def age_days(ts: Column, as_of: str) -> Column:
    """Whole days from ts to as_of; a ts in the future is 0 days old, null stays null."""
    d = F.floor((F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0))).cast("long")
