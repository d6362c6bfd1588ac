"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value: datetime | str | Column) -> Column:
    """A zone-less UTC timestamp literal; text, datetime or column."""
    if isinstance(value, Column):
        return value
    return F.lit(to_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def to_datetime(value: datetime | str) -> datetime:
    """A zone-less UTC time; an offset is applied, none means UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


def as_utc(source: Column, dtype: str) -> Column:
    """A stored time as zone-less UTC, whatever the session zone.

    ``dtype`` is the stored type: an instant is written out in UTC, text with an
    offset is read as an instant, and other text as UTC.
    """
    if dtype == "timestamp_ntz":
        return source
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    if dtype == "timestamp":
        return F.timestamp_add("MICROSECOND", F.unix_micros(source), epoch)
    plain = source.cast("timestamp_ntz")
    if dtype != "string":
        return plain
    zoned = source.rlike("([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)$") & source.rlike("[T ][0-9]")
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(source.cast("timestamp")), epoch)
    return F.when(zoned, instant).otherwise(plain)


def ago(as_of: datetime | str, **delta) -> Column:
    """``as_of`` minus a fixed interval, as a literal the scan can use."""
    return ts(to_datetime(as_of) - timedelta(**delta))


def pct(part: Column, whole: Column) -> Column:
    """Coverage percentage; an empty whole counts as fully covered."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0
    return F.when(whole == 0, 100.0).otherwise(F.round(ratio, 2))


def micros(col: Column) -> Column:
    """Microseconds since the epoch, reading the zone-less time as UTC.

    Subtracting zone-less times ignores the session zone; ``timestampdiff``
    would read both in it and be off across clock changes.
    """
    since = (col - ts("1970-01-01 00:00:00")).cast("decimal(20,6)")
    return (since * 1_000_000).cast("bigint")


UNIT_US = {"SECOND": 1_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000}


def whole_units(unit: str, start: Column, end: Column) -> Column:
    """Whole seconds, hours or days from start to end, truncated toward zero."""
    elapsed = ((end - start).cast("decimal(20,6)") * 1_000_000).cast("bigint")
    return F.call_function("div", elapsed, F.lit(UNIT_US[unit]))


def needs_approval(obligations: Column) -> Column:
    return F.lower(obligations).like("%hitl%")


def n_if(cond: Column) -> Column:
    return F.count_if(cond)
