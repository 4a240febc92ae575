"""Continuously maintained results (Q-A, Q-B, partials, upsert, fan-out).

Each function takes a *typed* streaming DataFrame (decoded records, see
``typed_stream``) and a folder, starts the query, and returns the
StreamingQuery.  All sinks are ``foreachBatch`` writers keyed by
``batch_id`` (idempotent on replay, see ``runner``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import day_key, minute_start
from ..sources import event_log as EL
from ..sources import ingest as I
from . import runner

AGG_COLUMNS = ("event_count", "total_amount", "max_event_time")


def typed_rows(records: DataFrame, keep_position: bool = False, decode=I.decode_json) -> DataFrame:
    """Log records (batch or stream) -> typed rows; bad rows dropped.  ``decode``
    reads the message format (``decode_json``, ``decode_csv``)."""
    dec = decode(records)
    good = dec.where(~F.col("status").isin(*I.BAD))
    cols = list(I.TYPED_COLUMNS) + (["partition", "offset"] if keep_position else [])
    return good.select(*cols)


def typed_stream(spark: SparkSession, log_path: str, files_per_trigger: int | None = None,
                 keep_position: bool = False, decode=I.decode_json, **source) -> DataFrame:
    """Replay log -> decoded, typed rows; ``source``: options of ``stream_log``."""
    return typed_rows(EL.stream_log(spark, log_path, files_per_trigger=files_per_trigger, **source),
                      keep_position, decode)


def _aggs():
    return [F.count(F.lit(1)).alias("event_count"),
            F.sum("amount").cast("decimal(22,2)").alias("total_amount"),
            F.max("event_time").alias("max_event_time")]


# -- Q-B: running total per region --------------------------------------------

def qb_running_total(typed: DataFrame) -> DataFrame:
    """Unbounded-state running total (update mode: changed regions per batch).

    7 keys: the state is tiny; the partial aggregate before the stateful step
    keeps the shuffle at one row per (task, region) even for a hot region."""
    return typed.groupBy("region").agg(*_aggs())


# -- Q-A: 1-minute tumbling window, event time ---------------------------------

def qa_windows(typed: DataFrame, delay: str = "1 minute", time_col: str = "event_time") -> DataFrame:
    """Event-time tumbling windows behind a watermark.

    ``append`` mode emits each window once, after the watermark passes its
    end (final); ``update`` mode emits partials while it is open."""
    return (typed.withWatermark(time_col, delay)
            .groupBy(F.window(time_col, "1 minute"), "region")
            .agg(*_aggs())
            .select(F.col("window.start").alias("window_start"), "region", *AGG_COLUMNS))


def qa_processing_time(typed: DataFrame) -> DataFrame:
    """Q-A bucketed by processing time (the wall-clock minute a row is seen)."""
    return (typed.withColumn("proc_time", F.current_timestamp())
            .withWatermark("proc_time", "0 seconds")
            .groupBy(F.window("proc_time", "1 minute"), "region")
            .agg(*_aggs())
            .select(F.col("window.start").alias("window_start"), "region", *AGG_COLUMNS))


# -- stateless partial aggregates (merge on read) -------------------------------

def partials_qb(batch: DataFrame) -> DataFrame:
    return batch.groupBy("region").agg(*_aggs())


def partials_qa(batch: DataFrame) -> DataFrame:
    """Per-minute partials: a late row just adds to its old bucket."""
    return batch.groupBy(minute_start(F.col("event_time")).alias("window_start"),
                         "region").agg(*_aggs())


def partials_qc(batch: DataFrame) -> DataFrame:
    """Per-millisecond partials for Q-C: the last 5 minutes of a region are
    re-aggregated on read.  Event times have whole milliseconds, so the frame
    is exact; rows without an event time are in no frame."""
    return (batch.where(F.col("event_time").isNotNull())
            .groupBy(F.unix_millis(F.col("event_time")).alias("ms"), "region").agg(*_aggs()))


def partial_sink(path: str, fn):
    def write(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


# -- append table, day-partitioned and sorted ----------------------------------

def append_by_day_sink(path: str):
    """Append table partitioned by event_date and batch, sorted within files
    by (region, event_time, event_id) so row-group statistics skip well.

    No shuffle: each task sorts its own rows by (day, region, time, id) and
    writes one file per day it holds, so a day holding most of a batch is
    still written by every task, not funnelled into one."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("event_date", day_key(F.col("event_time")))
         .sortWithinPartitions("event_date", "region", "event_time", "event_id")
         .write.mode("overwrite").partitionBy("event_date")
         .parquet(f"{path}/batch_id={batch_id}"))
    return write


# -- fan-out: one scan, several sinks ---------------------------------------------

def fanout_sink(sinks: dict):
    """One micro-batch, persisted once, feeds every sink (each idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            for fn in sinks.values():
                fn(b, batch_id)
        finally:
            b.unpersist()
    return write


# -- late rows to a side table -----------------------------------------------

def late_split_sink(path: str, delay_seconds: int):
    """Never-drop route for late data.

    Rows older than (newest event time of all *earlier* batches - delay) are
    written to ``path/late``, the others - rows without an event time among
    them - to ``path/main``.  The running mark
    is a one-row table per batch (``path/_marks``), so the split is
    deterministic and replay-safe."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        from ..session import path_exists
        prev = None
        if path_exists(spark, f"{path}/_marks"):
            marks = spark.read.parquet(f"{path}/_marks").where(F.col("batch_id") < batch_id)
            prev = marks.agg(F.max("mark").alias("m")).first()["m"]
        b = batch
        try:
            if prev is None:
                late_cond = F.lit(False)
            else:
                wm = F.lit(prev).cast("timestamp") - F.make_dt_interval(
                    secs=F.lit(delay_seconds))
                late_cond = F.coalesce(F.col("event_time") < wm, F.lit(False))
            b = batch.withColumn("_late", late_cond).persist()
            b.where(~F.col("_late")).drop("_late").write.mode("overwrite") \
                .parquet(f"{path}/main/batch_id={batch_id}")
            b.where(F.col("_late")).drop("_late").write.mode("overwrite") \
                .parquet(f"{path}/late/batch_id={batch_id}")
            mark = b.agg(F.max("event_time").alias("mark"))
            if prev is not None:
                mark = mark.select(F.greatest("mark", F.lit(prev).cast("timestamp")).alias("mark"))
            mark.write.mode("overwrite").parquet(f"{path}/_marks/batch_id={batch_id}")
        finally:
            b.unpersist()
    return write


# -- error-rate stop and resume ----------------------------------------------

def decoded_stream(spark: SparkSession, log_path: str,
                   files_per_trigger: int | None = None) -> DataFrame:
    """Replay log -> decoded rows *with* their status (for guarded sinks)."""
    return I.decode_json(EL.stream_log(spark, log_path, files_per_trigger=files_per_trigger))


def guarded_sink(path: str, max_bad: int):
    """Stop the stream when a batch holds more than ``max_bad`` malformed rows.

    The check runs before anything is written, so the failed batch leaves no
    output; restarting from the same checkpoint (e.g. with a raised budget)
    re-runs exactly that batch.  Good rows land in ``path/batch_id=N``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            I.check_error_budget(b, max_bad)
            (b.where(~F.col("status").isin(*I.BAD)).select(*I.TYPED_COLUMNS)
             .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))
        finally:
            b.unpersist()
    return write
