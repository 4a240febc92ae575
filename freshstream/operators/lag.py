"""Lag and throughput measurements as data jobs.

Measured quantities come as tables:

  ticks(tick, observed_at, system, query, producer_max_et, result_max_et, duration_s)
  offsets(tick, observed_at, group_id, topic, partition, end_offset, committed_offset)

recorded from a running pipeline (``streaming.measure``).  Freshness and produce
rate over time need no measurement: they follow from the events' own ingest
times (the offsets are observed at every tick that sees an append or its commit,
``offset_log``).  Those are scanned once and reduced to one row per minute (partial
aggregate); running maxima and counts over minutes are two-level scans
(``operators.scan``): within (series, day) groups, plus a carry over one row per
(series, day) - no task holds the whole time axis.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import lag_ms, minute_start
from .scan import running, running_many, suffix_min_from
from ..session import materialize
from ..schema import HISTOGRAM_BOUNDS, TOPIC_PARTITIONS


# Replay rule of ``offset_log`` (fixed): a message is committed this long after its append.
CONSUMER_DELAY_MS = 30000
CONSUMER_GROUP = "freshstream-consumer"
TOPIC = "transactions"
TICK_MS = 60000


def slice_ms(*delays_ms: int) -> int:
    """Widest slice of ingest time that falls into one tick for every delay:
    slice starts, delays and tick starts are all multiples of it, so
    ``tick(t + d) == tick(slice_start(t) + d)`` for every ``t`` in a slice."""
    return math.gcd(TICK_MS, *delays_ms)


def _slice_start(ts: Column, width_ms: int) -> Column:
    w_us = width_ms * 1000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(w_us)).cast("long") * F.lit(w_us))


def _tick(ts):
    """The probe tick that first sees ``ts``: the end of its minute."""
    return minute_start(ts) + F.expr("INTERVAL 1 MINUTE")


def system_lag(ticks: DataFrame) -> DataFrame:
    """producer_max - result_max per (system, query): current, mean, max.
    Ticks at which a system shows no result have no lag."""
    lagged = ticks.withColumn("lag_ms", lag_ms(F.col("result_max_et"), F.col("producer_max_et")))
    return (lagged.where(F.col("lag_ms").isNotNull()).groupBy("system", "query")
            .agg(F.max_by("lag_ms", "tick").alias("current_lag_ms"),
                 F.avg("lag_ms").alias("avg_lag_ms"),
                 F.max("lag_ms").alias("max_lag_ms"),
                 F.count(F.lit(1)).alias("ticks")))


def probe_histogram(ticks: DataFrame, bounds=HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative duration histogram per (system, query): one count per bound
    (count_if, so each tick is read once) unpivoted to (le, count)."""
    labels = [repr(float(b)) for b in bounds] + ["+Inf"]
    aggs = [F.count_if(F.col("duration_s") <= F.lit(b)).alias(f"b{i}")
            for i, b in enumerate(bounds)] + [F.count(F.lit(1)).alias(f"b{len(bounds)}")]
    wide = ticks.groupBy("system", "query").agg(*aggs)
    stack = ", ".join(f"'{lab}', b{i}" for i, lab in enumerate(labels))
    return wide.selectExpr("system", "query", f"stack({len(labels)}, {stack}) AS (le, count)")


def freshness_series(txn: DataFrame) -> DataFrame:
    """Q3 evaluated at every 1-minute tick: newest event seen by the tick."""
    per_min = (txn.groupBy(_tick(F.col("ingest_time")).alias("tick_time"))
               .agg(F.max("event_time").alias("et")))
    return (running(materialize(per_min), [], "tick_time", F.col("et"), "newest_event_time", "max")
            .select("tick_time", "newest_event_time")
            .withColumn("freshness_lag_ms",
                        lag_ms(F.col("newest_event_time"), F.col("tick_time"))))


def offset_log(txn: DataFrame) -> DataFrame:
    """Per topic partition and tick: log end offset and the consumer group's
    committed offset (messages consumed = ingest + consumer delay)."""
    part = F.pmod(F.col("user_id"), F.lit(TOPIC_PARTITIONS)).cast("int")
    width = slice_ms(CONSUMER_DELAY_MS)
    slices = (txn.groupBy(part.alias("partition"),
                          _slice_start(F.col("ingest_time"), width).alias("_s"))
              .agg(F.count(F.lit(1)).alias("n")))
    both = slices.select("partition", F.explode(F.array(
        F.struct(_tick(F.col("_s")).alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("c")),
        F.struct(_tick(F.timestamp_add("MILLISECOND", F.lit(CONSUMER_DELAY_MS), F.col("_s")))
                 .alias("t"), F.lit(0).cast("long").alias("p"), F.col("n").alias("c"))
    )).alias("o"))
    per_min = (both.groupBy("partition", F.col("o.t").alias("t"))
               .agg(F.sum("o.p").alias("p"), F.sum("o.c").alias("c")))
    ran = running_many(materialize(per_min), ["partition"], "t", [
        ("end_offset", F.col("p"), "sum"), ("committed_offset", F.col("c"), "sum")])
    return ran.select(
        F.col("t").alias("observed_at"), F.lit(CONSUMER_GROUP).alias("group_id"),
        F.lit(TOPIC).alias("topic"), "partition", "end_offset", "committed_offset")


def produce_rate(offsets: DataFrame) -> DataFrame:
    """Per partition: messages appended between observations / seconds.

    The previous observation is found within (partition, day) groups; the
    first observation of a day takes the last one of the latest earlier
    day, carried over one row per (partition, day)."""
    d = offsets.withColumn("_day", F.date_trunc("day", F.col("observed_at")))
    w = Window.partitionBy("partition", "_day").orderBy("observed_at")
    inner = d.select("partition", "_day", "observed_at", "end_offset",
                     F.lag("end_offset").over(w).alias("_po"),
                     F.lag("observed_at").over(w).alias("_pt"))
    last = (d.groupBy("partition", "_day")
            .agg(F.max_by("end_offset", "observed_at").alias("_lo"),
                 F.max("observed_at").alias("_lt")))
    wd = Window.partitionBy("partition").orderBy("_day")
    carry = last.select("partition", "_day", F.lag("_lo").over(wd).alias("_co"),
                        F.lag("_lt").over(wd).alias("_ct"))
    j = inner.join(carry, ["partition", "_day"], "left")
    prev_o = F.coalesce(F.col("_po"), F.col("_co"))
    prev_t = F.coalesce(F.col("_pt"), F.col("_ct"))
    r = j.select("partition", "observed_at",
                 (F.col("end_offset") - prev_o).alias("delta_offsets"),
                 F.timestamp_diff("SECOND", prev_t, F.col("observed_at")).alias("delta_s"))
    return (r.where(F.col("delta_s").isNotNull())
            .withColumn("rate_per_s", F.col("delta_offsets") / F.col("delta_s")))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Newest observation per partition: end - committed; rolled up to the
    total of each group and topic (partition NULL); end_offset there is the
    topic's size in messages."""
    newest = (offsets.groupBy("group_id", "topic", "partition")
              .agg(F.max_by(F.struct("end_offset", "committed_offset"), "tick").alias("o")))
    lagged = newest.select("group_id", "topic", "partition", "o.end_offset",
                           "o.committed_offset",
                           (F.col("o.end_offset") - F.col("o.committed_offset")).alias("lag"))
    return (lagged.rollup("group_id", "topic", "partition")
            .agg(F.sum("end_offset").alias("end_offset"),
                 F.sum("committed_offset").alias("committed_offset"),
                 F.sum("lag").alias("lag"))
            .where(F.col("topic").isNotNull()))


def window_finalization(txn: DataFrame, delay_minutes: int = 1) -> DataFrame:
    """When each 1-minute event-time window could close: the arrival of the
    first row at or past window_end + delay (that row moves the watermark
    past the window): a suffix minimum of per-minute first arrivals, taken
    from window_end + delay (see ``scan.suffix_min_from``)."""
    per_min = (txn.groupBy(minute_start(F.col("event_time")).alias("m"))
               .agg(F.min("ingest_time").alias("first_ingest"),
                    F.max("event_time").alias("max_event_time")))
    # one row per minute, read three times below: written once
    per_min = materialize(per_min)
    points = per_min.select(
        F.col("m").alias("window_start"),
        (F.col("m") + F.expr("INTERVAL 1 MINUTE")).alias("window_end"), "max_event_time",
        (F.col("m") + F.expr(f"INTERVAL {1 + delay_minutes} MINUTES")).alias("needed"))
    fin = suffix_min_from(points, "needed", per_min, "m", "first_ingest", "emitted_at")
    return (fin.where(F.col("emitted_at").isNotNull())
            .select("window_start", "window_end", "max_event_time", "emitted_at"))
