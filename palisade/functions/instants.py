"""Time arithmetic on whole milliseconds."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def millis(instant: Column) -> Column:
    return F.unix_millis(instant)


def to_millis_precision(instant: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(instant))


def floor_to(value_ms: Column, step_ms: int) -> Column:
    """Start of the epoch-aligned step that holds ``value_ms``, also before 1970."""
    return value_ms - F.pmod(value_ms, F.lit(step_ms).cast("bigint"))


def as_datetime(value) -> datetime:
    """Accept an aware datetime, a naive one taken as UTC, or ISO-8601 text."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def earlier(value: datetime, span: timedelta | float) -> datetime | None:
    """``value - span`` (minutes, if a number); None where that lies before the first representable instant."""
    try:
        return value - (span if isinstance(span, timedelta) else timedelta(minutes=span))
    except OverflowError:
        return None


def epoch_micros(value) -> int:
    return (as_datetime(value) - EPOCH) // timedelta(microseconds=1)


def epoch_millis(value) -> int:
    return epoch_micros(value) // 1000


def instant_lit(value) -> Column:
    """A timestamp literal that does not depend on the driver's time zone."""
    return F.timestamp_micros(F.lit(epoch_micros(value)).cast("bigint"))
