"""Time differences that do not depend on the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: dt.datetime | str | Column) -> Column:
    """A fixed point in time; "now" is always a parameter, never the clock."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def seconds_between(earlier: Column, later: Column) -> Column:
    gap = (later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")).cast("interval second")
    return gap.cast("decimal(20,6)").cast("double")


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a local time, as a whole number."""
    gap = (ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    return (gap.cast("decimal(20,6)") * 1_000_000).cast("long")


def hours_before(now: Column, hours: float) -> Column:
    seconds = round(hours * 3600)
    return now - F.expr(f"INTERVAL '{seconds}' SECOND")
