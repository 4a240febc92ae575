"""Time expressions of the reference, as built-in Spark expressions.

All of these compile to JVM expressions inside whole-stage codegen; none is
a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EVENT_TIME_FORMAT


def parse_event_time(s: Column) -> Column:
    """Text -> TIMESTAMP, NULL on junk (never raises under ANSI).

    Accepts the source form with 'Z', the same without 'Z' (read as UTC),
    and any other form Spark's default parser accepts."""
    return F.coalesce(
        F.try_to_timestamp(s, F.lit(EVENT_TIME_FORMAT)),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")),
        F.try_to_timestamp(s),
    )


def format_event_time(ts: Column) -> Column:
    """TIMESTAMP -> the source text form ``yyyy-MM-dd'T'HH:mm:ss.SSS'Z'``."""
    return F.date_format(ts, EVENT_TIME_FORMAT)


def minute_start(ts: Column) -> Column:
    """toStartOfMinute / FLOOR(ts TO MINUTE) / DATE_TRUNC('MINUTE', ts)."""
    return F.date_trunc("minute", ts)


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def second_floor(ts: Column) -> Column:
    """toDateTime(ts): drop the sub-second part."""
    return F.date_trunc("second", ts)


def lag_ms(older: Column, newer: Column) -> Column:
    """dateDiff('millisecond', older, newer): true milliseconds."""
    return F.timestamp_diff("MILLISECOND", older, newer)


def lag_seconds(older: Column, newer: Column) -> Column:
    """dateDiff('second', older, newer): whole seconds, truncating."""
    return F.timestamp_diff("SECOND", older, newer)


def lag_ms_whole_seconds(older: Column, newer: Column) -> Column:
    """TIMESTAMPDIFF(SECOND, a, b) * 1000: the truncated-to-seconds variant."""
    return F.timestamp_diff("SECOND", older, newer) * F.lit(1000)


def minus_interval(ts: Column, minutes: int = 0, hours: int = 0) -> Column:
    return ts - F.make_dt_interval(hours=F.lit(hours), mins=F.lit(minutes))


def day_key(ts: Column) -> Column:
    """toYYYYMMDD as a DATE partition value."""
    return F.to_date(ts)


def hour_key(ts: Column) -> Column:
    """toYYYYMMDDhh as text ``yyyyMMddHH``."""
    return F.date_format(ts, "yyyyMMddHH")


def to_ntz(ts: Column) -> Column:
    """Session-zone TIMESTAMP -> TIMESTAMP_NTZ (UTC wall clock)."""
    return ts.cast("timestamp_ntz")
