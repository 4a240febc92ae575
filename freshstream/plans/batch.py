"""Registered batch queries (ops 29-37, 44, 63) over the supplied tables."""

from __future__ import annotations

import datetime as dt

from ..operators import regional as R
from ..operators.clock import AS_OF, MAX_DELAY
from ..operators.clock import clock as _clock
from ..schema import transactions
from ..session import fresh_dir
from ..tables import daily
from .registry import AS_OF_SQL, register, state_of, with_txn

_DAILY: dict = {}


def daily_table(spark, sf_dir):
    """The events in the day-partitioned append table, loaded once a session
    and state of the files."""
    from ..streaming.maintained import append_by_day_sink
    state = state_of(spark, sf_dir)
    if state not in _DAILY:
        path = fresh_dir(spark, "by-day")
        append_by_day_sink(path)(transactions(spark, sf_dir), 0)
        _DAILY[state] = path
    return _DAILY[state]


def _recent(spark, sf_dir, lookback):
    """(clock, rows since ``lookback`` before it) of the append table; the
    clock and the rows both read the newest partitions only."""
    path = daily_table(spark, sf_dir)
    live = spark.conf.get(AS_OF, "replay") != "replay"
    as_of = _clock(spark, sf_dir) if live else daily.newest_ingest(spark, path) or dt.datetime(1970, 1, 1)
    return as_of, daily.since(daily.read(spark, path), lookback(as_of))


@register("q1_regional", with_txn("""
SELECT region, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(22,2)) AS total,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
FROM transactions
WHERE event_time >= """ + AS_OF_SQL + """ - INTERVAL 1 HOUR
GROUP BY region ORDER BY total DESC"""))
def q1_regional(spark, sf_dir):
    """Q1: last hour per region (flagship)."""
    as_of, txn = _recent(spark, sf_dir, lambda t: t - dt.timedelta(hours=1))
    return R.q1_regional(txn, as_of)


@register("q1_all", with_txn("""
SELECT region, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(22,2)) AS total,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
FROM transactions GROUP BY region"""))
def q1_all(spark, sf_dir):
    """Q1's aggregate over the whole table (the union-read / full-scan form)."""
    return R.regional_aggregate(transactions(spark, sf_dir))


@register("q1_like", with_txn("""
SELECT region, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(22,2)) AS total,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
FROM transactions WHERE event_type LIKE '%i%' AND region NOT LIKE 'us-%' GROUP BY region"""))
def q1_like(spark, sf_dir):
    """Q1 over rows picked by name patterns (LIKE)."""
    txn = transactions(spark, sf_dir)
    return R.regional_aggregate(txn.where("event_type LIKE '%i%' AND region NOT LIKE 'us-%'"))


@register("q2_tumbling", with_txn("""
SELECT date_trunc('minute', event_time) AS window_start, region,
       count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM transactions GROUP BY 1, 2
ORDER BY window_start DESC, total_amount DESC, region LIMIT 120"""))
def q2_tumbling(spark, sf_dir):
    return R.q2_tumbling(transactions(spark, sf_dir))


@register("q2_all_windows", with_txn("""
SELECT date_trunc('minute', event_time) AS window_start, region,
       count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM transactions GROUP BY 1, 2"""))
def q2_all_windows(spark, sf_dir):
    return R.q2_all_windows(transactions(spark, sf_dir))


@register("q3_freshness", with_txn("""
SELECT max(event_time) AS newest_event_time,
       """ + AS_OF_SQL + """ AS query_time,
       date_diff('millisecond', max(event_time), """ + AS_OF_SQL + """) AS freshness_lag_ms,
       date_sub('second', max(event_time), """ + AS_OF_SQL + """) AS freshness_lag_seconds,
       max(ingest_time) AS newest_ingest_time,
       date_diff('millisecond', max(event_time), max(ingest_time)) AS pipeline_lag_ms,
       count(*) AS total_rows
FROM transactions"""))
def q3_freshness(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    return R.q3_freshness(txn, _clock(spark, sf_dir))


@register("q3_freshness_sec", with_txn("""
SELECT max(event_time) AS newest_event_time,
       """ + AS_OF_SQL + """ AS query_time,
       date_sub('second', max(event_time), """ + AS_OF_SQL + """) * 1000 AS freshness_lag_ms,
       date_sub('second', max(event_time), max(ingest_time)) * 1000 AS pipeline_lag_ms,
       count(*) AS total_rows
FROM transactions"""))
def q3_freshness_sec(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    return R.q3_freshness_sec(txn, _clock(spark, sf_dir))


@register("ingest_rate", with_txn("""
SELECT date_trunc('minute', ingest_time) AS minute, count(*) AS messages_ingested,
       ((count(*) + 3) // 6) / 10.0 AS msgs_per_sec
FROM transactions
WHERE ingest_time >= """ + AS_OF_SQL + """ - INTERVAL 5 MINUTE
GROUP BY 1 ORDER BY minute DESC"""))
def ingest_rate(spark, sf_dir):
    # a row is ingested within MAX_DELAY after its event: the scan bound is wider by it
    as_of, txn = _recent(spark, sf_dir, lambda t: t - dt.timedelta(minutes=5) - MAX_DELAY)
    return R.ingest_rate(txn, as_of)


@register("last_5min", with_txn("""
SELECT 'last_5min' AS probe, max(event_time) AS max_event_time, count(*) AS rows
FROM transactions WHERE event_time >= """ + AS_OF_SQL + """ - INTERVAL 5 MINUTE"""))
def last_5min(spark, sf_dir):
    as_of, txn = _recent(spark, sf_dir, lambda t: t - dt.timedelta(minutes=5))
    return R.last_5min(txn, as_of)


@register("current_minute", with_txn("""
SELECT 'current_minute' AS probe, max(event_time) AS max_event_time, count(*) AS rows
FROM transactions WHERE event_time >= date_trunc('minute', """ + AS_OF_SQL + """)"""))
def current_minute(spark, sf_dir):
    as_of, txn = _recent(spark, sf_dir, lambda t: t.replace(second=0, microsecond=0))
    return R.current_minute(txn, as_of)


@register("recent_buckets", with_txn("""
SELECT date_trunc('minute', event_time) AS window_start, region,
       count(*) AS event_count, max(event_time) AS max_event_time
FROM transactions
WHERE date_trunc('minute', event_time) >= """ + AS_OF_SQL + """ - INTERVAL 2 MINUTE
GROUP BY 1, 2"""))
def recent_buckets(spark, sf_dir):
    as_of, txn = _recent(spark, sf_dir, lambda t: t - dt.timedelta(minutes=2))
    return R.recent_buckets(txn, as_of)


@register("qc_rescan", with_txn("""
SELECT region, count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount,
       max(event_time) AS max_event_time
FROM transactions WHERE event_time >= """ + AS_OF_SQL + """ - INTERVAL 5 MINUTE
GROUP BY region"""))
def qc_rescan(spark, sf_dir):
    as_of, txn = _recent(spark, sf_dir, lambda t: t - dt.timedelta(minutes=5))
    return R.qc_rescan(txn, as_of)


@register("scalar_time", with_txn("""
SELECT event_id,
       date_trunc('minute', event_time) AS minute_start,
       date_trunc('hour', event_time) AS hour_start,
       date_trunc('second', event_time) AS second_floor,
       CAST(event_time AS DATE) AS event_date,
       strftime(event_time, '%Y%m%d%H') AS event_hour,
       strftime(event_time, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_time_text,
       event_time AS event_time_parsed,
       event_time - INTERVAL 1 HOUR AS minus_1h,
       event_time + INTERVAL 2 HOUR AS plus_2h,
       date_diff('millisecond', event_time, ingest_time) AS lag_ms,
       date_sub('second', event_time, ingest_time) AS lag_s,
       date_sub('second', event_time, ingest_time) * 1000 AS lag_ms_whole_s
FROM transactions"""))
def scalar_time(spark, sf_dir):
    return R.scalar_time(transactions(spark, sf_dir))


@register("qc_over_batch", with_txn("""
SELECT event_id, region, event_time,
       count(event_id) OVER w AS event_count,
       CAST(sum(amount) OVER w AS DECIMAL(22,2)) AS total_amount,
       max(event_time) OVER w AS max_event_time
FROM transactions
WINDOW w AS (PARTITION BY region ORDER BY event_time
             RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW)"""))
def qc_over_batch(spark, sf_dir):
    """Q-C per event: COUNT/SUM/MAX over the preceding 5 minutes of its region."""
    from ..operators.overwin import over_range
    return over_range(transactions(spark, sf_dir))


@register("qc_hopping", with_txn("""
SELECT window_start, region, count(*) AS event_count,
       CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount, max(event_time) AS max_event_time,
       window_start + INTERVAL 300 SECOND AS window_end
FROM (SELECT t.*, time_bucket(INTERVAL 10 SECOND, event_time) - k * INTERVAL 10 SECOND
                  AS window_start
      FROM transactions t, range(30) AS r(k))
GROUP BY window_start, region"""))
def qc_hopping(spark, sf_dir):
    """Q-C as 5-minute windows sliding every 10 seconds."""
    from ..operators.overwin import hopping
    return hopping(transactions(spark, sf_dir))


@register("q1_by_nation", with_txn("""
SELECT r.r_name, n.n_name, count(*) AS cnt, CAST(sum(t.amount) AS DECIMAL(22,2)) AS total
FROM transactions t
LEFT JOIN customer c ON t.user_id = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1, 2"""))
def q1_by_nation(spark, sf_dir):
    """Batch equi-join of the live table with the customer geography."""
    from ..operators.joins import totals_by_nation
    from ..schema import table
    return totals_by_nation(transactions(spark, sf_dir), table(spark, sf_dir, "customer"),
                            table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))
