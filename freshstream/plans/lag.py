"""Registered lag / throughput measurement queries (ops 52-58, 38)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import lag_ms
from ..operators import lag as G
from ..schema import table, transactions, transactions_from_events
from ..sources import event_log as EL
from ..streaming import measure
from .registry import register, state_of, with_txn

# Ticks of the recorded run, as ``measure.record`` makes them: equal spans of
# event time; a system shows what its last advance (every n-th tick) consumed.
TICKS = 5
TICKS_CTE = f"""span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
cuts AS (SELECT CAST(k AS BIGINT) AS k, make_timestamp((lo + ((hi - lo) * k) // {TICKS}) // 1000 * 1000) AS cut
         FROM span, range(1, {TICKS}) AS r(k)),
ticked AS (SELECT t.*, (SELECT count(*) FROM cuts WHERE cut <= t.event_time) AS tick FROM transactions t),
systems AS (SELECT * FROM (VALUES ('stream', 1), ('partials', 2), ('append', 3)) AS s(system, cadence)),
shown AS (SELECT i AS tick, system, (i + 1) // cadence * cadence - 1 AS upto
          FROM range(0, {TICKS}) AS r(i), systems),
marks AS (SELECT i AS tick, max(event_time) AS mark FROM range(-1, {TICKS}) AS r(i) JOIN ticked ON tick <= i
          GROUP BY 1),
ticks AS (
  SELECT s.tick, s.system, q.query, p.mark AS producer_max_et,
         (SELECT max(event_time) FROM ticked t WHERE t.tick <= s.upto
            AND (s.system <> 'stream' OR q.query <> 'qa'
                 OR date_trunc('minute', event_time) + INTERVAL 1 MINUTE
                    <= (SELECT mark FROM marks m WHERE m.tick = s.upto) - INTERVAL 1 MINUTE)) AS result_max_et
  FROM shown s JOIN marks p ON p.tick = s.tick, (VALUES ('qa'), ('qb'), ('qc')) AS q(query))"""
OFFSETS_CTE = """offsets AS (
  SELECT t AS observed_at, 'freshstream-consumer' AS group_id, 'transactions' AS topic,
         partition,
         CAST(sum(p) OVER w AS BIGINT) AS end_offset,
         CAST(sum(c) OVER w AS BIGINT) AS committed_offset
  FROM (SELECT partition, t, sum(p) AS p, sum(c) AS c FROM (
          SELECT CAST(user_id % 12 AS INTEGER) AS partition,
                 date_trunc('minute', ingest_time) + INTERVAL 1 MINUTE AS t, 1 AS p, 0 AS c
          FROM transactions
          UNION ALL
          SELECT CAST(user_id % 12 AS INTEGER),
                 date_trunc('minute', ingest_time + INTERVAL 30 SECOND) + INTERVAL 1 MINUTE,
                 0, 1
          FROM transactions) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY partition ORDER BY t
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _txn(spark, sf_dir):
    return transactions(spark, sf_dir)


_RECORDED: dict = {}


def recorded(spark, sf_dir):
    """The recorded run over the events (``streaming.measure``), once a session
    and state of the files."""
    state = state_of(spark, sf_dir)
    if state not in _RECORDED:
        chunks = EL.time_chunks(table(spark, sf_dir, "events"), TICKS)
        _RECORDED[state] = measure.record(
            spark, [EL.records_from_transactions(transactions_from_events(c)) for c in chunks])
    return _RECORDED[state]


@register("system_lag", with_txn("""
SELECT system, query, CAST(arg_max(lag_ms, tick) AS BIGINT) AS current_lag_ms, avg(lag_ms) AS avg_lag_ms,
       max(lag_ms) AS max_lag_ms, count(*) AS ticks
FROM (SELECT *, date_diff('millisecond', result_max_et, producer_max_et) AS lag_ms FROM ticks)
WHERE lag_ms IS NOT NULL GROUP BY 1, 2""", TICKS_CTE))
def system_lag(spark, sf_dir):
    """Source high mark - newest event of each system's result, per (system,
    query), over the recorded ticks at which it showed one."""
    return G.system_lag(measure.ticks(spark, recorded(spark, sf_dir)))


@register("probe_histogram")
def probe_histogram(spark, sf_dir):
    """Cumulative histogram of the recorded probe durations per (system,
    query).  Durations are wall time, so there is no oracle over the supplied
    tables; tests compute it in SQL from the recorded ticks."""
    return G.probe_histogram(measure.ticks(spark, recorded(spark, sf_dir)))


@register("freshness_series", with_txn("""
SELECT tick_time, newest_event_time,
       date_diff('millisecond', newest_event_time, tick_time) AS freshness_lag_ms
FROM (SELECT tick_time, max(et) OVER (ORDER BY tick_time
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest_event_time
      FROM (SELECT date_trunc('minute', ingest_time) + INTERVAL 1 MINUTE AS tick_time,
                   max(event_time) AS et FROM transactions GROUP BY 1))"""))
def freshness_series(spark, sf_dir):
    """Q3 at every 1-minute tick (the freshness time series)."""
    return G.freshness_series(_txn(spark, sf_dir))


@register("produce_rate", with_txn("""
SELECT partition, observed_at, delta_offsets, delta_s,
       delta_offsets / delta_s AS rate_per_s
FROM (SELECT partition, observed_at,
             end_offset - lag(end_offset) OVER w AS delta_offsets,
             date_sub('second', lag(observed_at) OVER w, observed_at) AS delta_s
      FROM offsets WINDOW w AS (PARTITION BY partition ORDER BY observed_at))
WHERE delta_s IS NOT NULL""", OFFSETS_CTE))
def produce_rate(spark, sf_dir):
    """Messages appended per second, per partition, between observations: every
    tick that sees an append or the consumer's commit of one."""
    return G.produce_rate(G.offset_log(_txn(spark, sf_dir)))


@register("consumer_lag", with_txn("""
SELECT group_id, 'transactions' AS topic, partition, CAST(count(user_id) AS BIGINT) AS end_offset,
       CAST(count_if(tick <= upto) AS BIGINT) AS committed_offset,
       CAST(count_if(tick > upto) AS BIGINT) AS lag
FROM (SELECT g.group_id, p.partition, s.upto
      FROM (VALUES ('stream-qa', 'stream'), ('stream-qb', 'stream'), ('stream-qc', 'stream'),
                   ('partials', 'partials'), ('append', 'append')) AS g(group_id, system)
      JOIN shown s ON s.system = g.system AND s.tick = (SELECT max(tick) FROM shown),
      (SELECT CAST(range AS INTEGER) AS partition FROM range(12)) AS p) gp
LEFT JOIN ticked t ON t.user_id % 12 = gp.partition
GROUP BY ROLLUP (group_id, topic, partition) HAVING group_id IS NOT NULL AND topic IS NOT NULL""", TICKS_CTE))
def consumer_lag(spark, sf_dir):
    """Consumer lag by partition and for each group (rollup row): messages in
    the log less messages its batches consumed, as recorded."""
    return G.consumer_lag(measure.offsets(spark, recorded(spark, sf_dir)))


@register("measured_finalization", with_txn("""
SELECT w AS window_start, region, mark - INTERVAL 1 MINUTE AS watermark,
       date_diff('millisecond', w + INTERVAL 1 MINUTE, mark - INTERVAL 1 MINUTE) AS finalization_lag_ms
FROM (SELECT w, region, (SELECT min(mark) FROM marks
                         WHERE w + INTERVAL 1 MINUTE <= mark - INTERVAL 1 MINUTE) AS mark
      FROM (SELECT DISTINCT date_trunc('minute', event_time) AS w, region FROM transactions))
WHERE mark IS NOT NULL""", TICKS_CTE))
def measured_finalization(spark, sf_dir):
    """How far event time had run past each closed window when its result was
    emitted: the watermark of the emitting batch (listener progress), joined
    to the rows that batch wrote, minus the window's end."""
    f = measure.finalized(spark, recorded(spark, sf_dir))
    return f.select("window_start", "region", "watermark",
                    lag_ms(F.col("window_end"), F.col("watermark")).alias("finalization_lag_ms"))


@register("measured_latency", with_txn("""
SELECT w AS window_start, region, newest AS max_event_time, mark AS producer_max_et,
       date_diff('millisecond', newest, mark) AS result_latency_ms
FROM (SELECT w, region, newest, (SELECT min(mark) FROM marks
                                 WHERE w + INTERVAL 1 MINUTE <= mark - INTERVAL 1 MINUTE) AS mark
      FROM (SELECT date_trunc('minute', event_time) AS w, region, max(event_time) AS newest
            FROM transactions GROUP BY 1, 2))
WHERE mark IS NOT NULL""", TICKS_CTE))
def measured_latency(spark, sf_dir):
    """Result latency per result: the source's high mark at the tick that
    showed a window's result, minus the newest event in it."""
    root = recorded(spark, sf_dir)
    marks = measure.ticks(spark, root).where("system = 'stream' AND query = 'qa'").select(
        "producer_max_et", (F.col("producer_max_et") - F.expr("INTERVAL 1 MINUTE")).alias("watermark")).distinct()
    rows = measure.finalized(spark, root).join(F.broadcast(marks), "watermark")
    return rows.select("window_start", "region", "max_event_time", "producer_max_et",
                       lag_ms(F.col("max_event_time"), F.col("producer_max_et")).alias("result_latency_ms"))


FINAL_CTE = """fin AS (
  SELECT window_start, window_start + INTERVAL 1 MINUTE AS window_end, max_event_time,
         min(first_ingest) OVER (ORDER BY epoch(window_start)
             RANGE BETWEEN 120 FOLLOWING AND UNBOUNDED FOLLOWING) AS emitted_at
  FROM (SELECT date_trunc('minute', event_time) AS window_start,
               min(ingest_time) AS first_ingest, max(event_time) AS max_event_time
        FROM transactions GROUP BY 1))"""


@register("finalization_lag", with_txn("""
SELECT window_start, window_end, emitted_at,
       date_diff('millisecond', window_end, emitted_at) AS finalization_lag_ms
FROM fin WHERE emitted_at IS NOT NULL""", FINAL_CTE))
def finalization_lag(spark, sf_dir):
    """Closed window -> time its final result can appear (watermark 1 min)."""
    f = G.window_finalization(_txn(spark, sf_dir))
    return f.select("window_start", "window_end", "emitted_at",
                    lag_ms(F.col("window_end"), F.col("emitted_at")).alias("finalization_lag_ms"))


@register("result_latency", with_txn("""
SELECT window_start, max_event_time, emitted_at,
       date_diff('millisecond', max_event_time, emitted_at) AS result_latency_ms
FROM fin WHERE emitted_at IS NOT NULL""", FINAL_CTE))
def result_latency(spark, sf_dir):
    """End-to-end: newest event of a result -> result emitted."""
    f = G.window_finalization(_txn(spark, sf_dir))
    return f.select("window_start", "max_event_time", "emitted_at",
                    lag_ms(F.col("max_event_time"), F.col("emitted_at"))
                    .alias("result_latency_ms"))


@register("table_sizes")
def table_sizes(spark, sf_dir):
    """Rows, compressed / uncompressed bytes and ratio of every supplied table
    (footer sizes; checked against DuckDB's parquet_metadata in tests)."""
    from ..operators.sizes import table_sizes as sizes
    from ..schema import TABLES
    return sizes(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES})
