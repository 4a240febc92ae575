"""Batch queries over the typed table: Q1, Q2, Q3 and the time-filter probes.

Every query is a declarative DataFrame plan: a pushed-down time predicate,
a partial (map-side) aggregate, one shuffle on the group key, and a final
aggregate.  Group keys are low-cardinality (7 regions, minutes), so even a
region holding a third of all rows is combined map-side before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import (lag_ms, lag_ms_whole_seconds, lag_seconds, minute_start)
from .clock import lit_ts


def _total(c="amount"):
    # Spark's own sum type for DECIMAL(12,2); wide enough for any row count.
    return F.sum(c).cast("decimal(22,2)")


def regional_aggregate(txn: DataFrame) -> DataFrame:
    """region, cnt, total, avg_amount.  The average skips NULL amounts, as
    AVG does: total / count(amount), NULL where a region has none."""
    return (txn.groupBy("region")
            .agg(F.count(F.lit(1)).alias("cnt"),
                 _total().alias("total"), F.count("amount").alias("_amounts"))
            .select("region", "cnt", "total",
                    F.when(F.col("_amounts") > 0, F.col("total").cast("double") / F.col("_amounts"))
                    .alias("avg_amount"))
            .orderBy(F.desc("total"), F.asc("region")))


def q1_regional(txn: DataFrame, as_of: dt.datetime, lookback=dt.timedelta(hours=1)) -> DataFrame:
    """Q1: regional aggregate of the last hour before ``as_of``.

    ``txn`` should already carry the scan-level bound (see
    ``schema.transactions(since=...)``); the typed predicate is repeated so
    the operator is correct on any input."""
    lo = as_of - lookback
    return regional_aggregate(txn.where(F.col("event_time") >= lit_ts(lo)))


def minute_buckets(txn: DataFrame, time_col: str = "event_time") -> DataFrame:
    """(window_start, region) -> event_count, total_amount.  A tumbling
    1-minute window is a truncation, so no Expand/window struct is planned."""
    return (txn.groupBy(minute_start(F.col(time_col)).alias("window_start"), "region")
            .agg(F.count(F.lit(1)).alias("event_count"), _total().alias("total_amount")))


def q2_tumbling(txn: DataFrame, limit: int = 120) -> DataFrame:
    """Q2: newest ``limit`` (window, region) buckets; region breaks ties.

    orderBy+limit plans as TakeOrderedAndProject: each task keeps its own
    top-``limit`` and only those reach the single final task."""
    return (minute_buckets(txn)
            .orderBy(F.desc("window_start"), F.desc("total_amount"), F.asc("region"))
            .limit(limit))


def q2_all_windows(txn: DataFrame) -> DataFrame:
    """Q2 without the limit: every bucket, unordered."""
    return minute_buckets(txn)


def q3_freshness(txn: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Q3: freshness probe, true milliseconds, plus the whole-second forms."""
    now = lit_ts(as_of)
    agg = txn.agg(F.max("event_time").alias("newest_event_time"),
                  F.max("ingest_time").alias("newest_ingest_time"),
                  F.count(F.lit(1)).alias("total_rows"))
    return agg.select(
        "newest_event_time",
        now.alias("query_time"),
        lag_ms(F.col("newest_event_time"), now).alias("freshness_lag_ms"),
        lag_seconds(F.col("newest_event_time"), now).alias("freshness_lag_seconds"),
        "newest_ingest_time",
        lag_ms(F.col("newest_event_time"), F.col("newest_ingest_time")).alias("pipeline_lag_ms"),
        "total_rows",
    )


def q3_freshness_sec(txn: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Q3 as the whole-second engines compute it: TIMESTAMPDIFF(SECOND)*1000."""
    now = lit_ts(as_of)
    agg = txn.agg(F.max("event_time").alias("newest_event_time"),
                  F.max("ingest_time").alias("newest_ingest_time"),
                  F.count(F.lit(1)).alias("total_rows"))
    return agg.select(
        "newest_event_time",
        now.alias("query_time"),
        lag_ms_whole_seconds(F.col("newest_event_time"), now).alias("freshness_lag_ms"),
        lag_ms_whole_seconds(F.col("newest_event_time"), F.col("newest_ingest_time"))
        .alias("pipeline_lag_ms"),
        "total_rows",
    )


def ingest_rate(txn: DataFrame, as_of: dt.datetime, lookback=dt.timedelta(minutes=5)) -> DataFrame:
    """Per-minute ingest rate over the last 5 minutes of ingest time.

    msgs_per_sec = round(count / 60, 1) rounded half-up exactly, computed in
    integers ((count + 3) div 6) / 10 so no binary-fraction rounding slips."""
    lo = as_of - lookback
    return (txn.where(F.col("ingest_time") >= lit_ts(lo))
            .groupBy(minute_start(F.col("ingest_time")).alias("minute"))
            .agg(F.count(F.lit(1)).alias("messages_ingested"))
            .withColumn("msgs_per_sec",
                        F.expr("(messages_ingested + 3) div 6").cast("double") / F.lit(10.0))
            .orderBy(F.desc("minute")))


def max_probe(txn: DataFrame, predicate, probe: str) -> DataFrame:
    """MAX(event_time) and row count under one time predicate."""
    return (txn.where(predicate)
            .agg(F.max("event_time").alias("max_event_time"),
                 F.count(F.lit(1)).alias("rows"))
            .select(F.lit(probe).alias("probe"), "max_event_time", "rows"))


def last_5min(txn: DataFrame, as_of: dt.datetime) -> DataFrame:
    lo = as_of - dt.timedelta(minutes=5)
    return max_probe(txn, F.col("event_time") >= lit_ts(lo), "last_5min")


def current_minute(txn: DataFrame, as_of: dt.datetime) -> DataFrame:
    lo = as_of.replace(second=0, microsecond=0)
    return max_probe(txn, F.col("event_time") >= lit_ts(lo), "current_minute")


def recent_buckets(txn: DataFrame, as_of: dt.datetime, minutes: int = 2) -> DataFrame:
    """Q-A probe: minute buckets starting at or after as_of - 2 min."""
    lo = as_of - dt.timedelta(minutes=minutes)
    return (txn.withColumn("window_start", minute_start(F.col("event_time")))
            .where(F.col("window_start") >= lit_ts(lo))
            .groupBy("window_start", "region")
            .agg(F.count(F.lit(1)).alias("event_count"),
                 F.max("event_time").alias("max_event_time")))


def qc_rescan(txn: DataFrame, as_of: dt.datetime, window=dt.timedelta(minutes=5)) -> DataFrame:
    """Q-C by re-scan: aggregate of the rows in the last 5 minutes, per region."""
    lo = as_of - window
    return (txn.where(F.col("event_time") >= lit_ts(lo))
            .groupBy("region")
            .agg(F.count(F.lit(1)).alias("event_count"), _total().alias("total_amount"),
                 F.max("event_time").alias("max_event_time")))


def scalar_time(txn: DataFrame) -> DataFrame:
    """Every time function of the reference, applied to each row."""
    et = F.col("event_time")
    from ..functions import time as tf
    return txn.select(
        "event_id",
        tf.minute_start(et).alias("minute_start"),
        tf.hour_start(et).alias("hour_start"),
        tf.second_floor(et).alias("second_floor"),
        tf.day_key(et).alias("event_date"),
        tf.hour_key(et).alias("event_hour"),
        tf.format_event_time(et).alias("event_time_text"),
        tf.parse_event_time(tf.format_event_time(et)).alias("event_time_parsed"),
        tf.minus_interval(et, hours=1).alias("minus_1h"),
        (et + F.expr("INTERVAL 2 HOURS")).alias("plus_2h"),
        tf.lag_ms(et, F.col("ingest_time")).alias("lag_ms"),
        tf.lag_seconds(et, F.col("ingest_time")).alias("lag_s"),
        tf.lag_ms_whole_seconds(et, F.col("ingest_time")).alias("lag_ms_whole_s"),
    )
