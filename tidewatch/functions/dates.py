"""Date arithmetic of release calendars as column expressions. All dates are DATE; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "QUARTER").cast("date")


def quarter_end(start: Column) -> Column:
    """The last day of the quarter that begins on ``start``."""
    return F.date_sub(F.add_months(start, 3), 1)


def shift_quarter(start: Column, n: int) -> Column:
    return F.add_months(start, 3 * n)


def period_end(d: Column, freq: Column) -> Column:
    """Last day of the quarter or month; weeks and days are their own end. Another frequency raises."""
    f = F.upper(freq)
    bad = F.raise_error(F.concat(F.lit("unknown frequency: "), F.coalesce(freq, F.lit("null")))).cast("date")
    return F.when(f == "Q", quarter_end(quarter_start(d))).when(f == "M", F.last_day(d)).when(f.isin("W", "D"), d).otherwise(bad)


def release_base(d: Column, freq: Column) -> Column:
    """What a release lag counts from: the period's end, or the date itself for any other frequency than Q and M."""
    f = F.upper(freq)
    return F.when(f == "Q", quarter_end(quarter_start(d))).when(f == "M", F.last_day(d)).otherwise(d)


def release_date(d: Column, freq: Column, lag_days: Column) -> Column:
    return F.date_add(release_base(d, freq), lag_days)


def available_date(release: Column, vintage: Column, strict: bool = False) -> Column:
    """When a value can be seen: on its release, or in strict mode not before its vintage either."""
    return F.greatest(release, vintage) if strict else release


def sticky_target(origin: Column, lag_days: int) -> Column:
    """The quarter that an origin date forecasts: the previous one up to and with its release day, then the running one."""
    start = quarter_start(origin)
    return F.when(origin <= F.date_add(F.date_sub(start, 1), lag_days), F.add_months(start, -3)).otherwise(start)


def quarter_release(ref_period: Column, lag_days: int) -> Column:
    """Release day of a quarter by its lag alone."""
    return F.date_add(quarter_end(ref_period), lag_days)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def day_spine(start: Column, end: Column) -> Column:
    """One row for each day from start to end; no rows if start is after end."""
    return F.explode(F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>")))
