"""Measurements of a running pipeline, recorded while it runs.

``record`` appends a log tick by tick, lets three systems consume it, and after
every tick probes what each of them shows:

  stream    stateful queries: Q-A (closed windows), Q-B, Q-C
  partials  one query, partial aggregates per batch, merged on read
  append    one query into the day-partitioned table, re-scanned by probes

A system's consumers are advanced every ``cadence`` ticks (its flush interval),
so slower ones really are behind; those of cadence 1 run on as live queries, the
others are started on their checkpoint when they are due.  Recorded, all from the run:

  ticks     (tick, observed_at, system, query, producer_max_et, result_max_et, duration_s):
            the source's high mark (last message per partition), the newest event
            in the result table as read by the probe, the probe's wall time
  offsets   (tick, observed_at, group_id, topic, partition, end_offset, committed_offset):
            messages in the log, and messages the group has consumed by the
            ``observe`` metrics of its batches
  progress  one row per micro-batch from the streaming listener, watermark included
  results   the stamped windows of stream Q-A, under their batch_id

The driver holds one number per partition and group; everything else is a job.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import producer_high_mark
from ..schema import TOPIC_PARTITIONS
from ..session import fresh_dir
from ..sources import event_log as EL
from ..sources import ingest as I
from ..tables import keyed as K
from . import maintained as M
from . import runner
from .listener import ProgressRecorder
from .qc_state import qc_stateful

TOPIC = "transactions"
CADENCE = {"stream": 1, "partials": 2, "append": 3}
REGION_STATE_PARTITIONS = 8
TICK_SCHEMA = ("tick INT, observed_at TIMESTAMP, system STRING, query STRING, producer_max_et TIMESTAMP, "
               "result_max_et TIMESTAMP, duration_s DOUBLE")
OFFSET_SCHEMA = ("tick INT, observed_at TIMESTAMP, group_id STRING, topic STRING, partition INT, "
                 "end_offset BIGINT, committed_offset BIGINT")


def observed_stream(spark: SparkSession, log: str, group: str, preset: str) -> DataFrame:
    """The typed log, with messages per partition observed on every batch."""
    raw = EL.stream_log(spark, log, preset=preset).observe(
        group, F.count(F.lit(1)).alias("messages"),
        *[F.count_if(F.col("partition") == p).alias(f"p{p}") for p in range(TOPIC_PARTITIONS)])
    good = I.decode_json(raw).where(~F.col("status").isin(*I.BAD))
    return good.select(*I.TYPED_COLUMNS)


@dataclass
class Group:
    """One consumer group: a query on its own checkpoint."""
    name: str
    system: str
    mode: str
    build: object
    sink: object
    state_partitions: int | None = None
    live: bool = False
    checkpoint: str = ""
    query: object = None
    consumed: Counter = field(default_factory=Counter)


def newest(spark: SparkSession, path: str, column: str) -> dt.datetime | None:
    """The newest event a result table shows (NULL while it is not there)."""
    table = K._read_or_none(spark, path)
    if table is None or column not in table.columns:
        return None
    return table.agg(F.max(column).alias("m")).first()["m"]


def record(spark: SparkSession, ticks: list[DataFrame], cadence: dict[str, int] | None = None,
           preset: str = "catch_up") -> str:
    """Run the pipeline over ``ticks`` (log chunks, oldest first); returns the
    folder of the recorded tables."""
    cadence = cadence or CADENCE
    root, log = fresh_dir(spark, "recorded"), fresh_dir(spark, "log-recorded")
    out = {q: f"{root}/results/{q}" for q in ("qa", "qb", "qc", "partials", "append")}
    typed = lambda name: observed_stream(spark, log, name, preset)
    fan = M.fanout_sink({q: M.partial_sink(f"{out['partials']}/{q}", fn) for q, fn in
                         (("qa", M.partials_qa), ("qb", M.partials_qb), ("qc", M.partials_qc))})
    groups = [
        Group("stream-qa", "stream", "append", lambda: M.qa_windows(typed("stream-qa"), "1 minute"),
              runner.stamped_writer(out["qa"])),
        Group("stream-qb", "stream", "update", lambda: M.qb_running_total(typed("stream-qb")),
              runner.batch_writer(out["qb"]), REGION_STATE_PARTITIONS),
        Group("stream-qc", "stream", "update", lambda: qc_stateful(typed("stream-qc")),
              runner.batch_writer(out["qc"]), REGION_STATE_PARTITIONS),
        Group("partials", "partials", "append", lambda: typed("partials"), fan),
        Group("append", "append", "append", lambda: typed("append"), M.append_by_day_sink(out["append"]))]
    for g in groups:
        g.checkpoint, g.live = f"{root}/checkpoints/{g.name}", cadence[g.system] == 1
    probes = ([("stream", q, out[q], "max_event_time") for q in ("qa", "qb", "qc")]
              + [("partials", q, f"{out['partials']}/{q}", "max_event_time") for q in ("qa", "qb", "qc")]
              + [("append", q, out["append"], "event_time") for q in ("qa", "qb", "qc")])
    recorder, produced, mark = ProgressRecorder(spark, f"{root}/progress"), Counter(), None
    spark.streams.addListener(recorder)
    try:
        for tick, chunk in enumerate(ticks):
            part = EL.append_chunk(chunk, log, tick)
            appended = EL.read_log(spark, part)          # the newest chunk only
            produced.update({r["partition"]: r["n"] for r in
                             appended.groupBy("partition").agg(F.count(F.lit(1)).alias("n")).collect()})
            high = producer_high_mark(appended).first()["producer_max_event_time"]
            mark = max((m for m in (mark, high) if m is not None), default=None)
            advance([g for g in groups if (tick + 1) % cadence[g.system] == 0], recorder)
            now, rows = dt.datetime.now(dt.timezone.utc), []
            for system, query, path, column in probes:
                begun = time.monotonic()
                shown = newest(spark, path, column)
                rows.append((tick, now, system, query, mark, shown, time.monotonic() - begun))
            spark.createDataFrame(rows, TICK_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/ticks")
            offsets = [(tick, now, g.name, TOPIC, p, produced[p], g.consumed[p])
                       for g in groups for p in range(TOPIC_PARTITIONS)]
            spark.createDataFrame(offsets, OFFSET_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/offsets")
    finally:
        for g in groups:
            if g.query is not None:
                g.query.stop()
        spark.streams.removeListener(recorder)
    return root


def advance(groups: list[Group], recorder: ProgressRecorder) -> None:
    """Let ``groups`` consume all there is (side by side, each on its own
    checkpoint), and take what their batches consumed from the progress."""
    for g in groups:
        if not g.live or g.query is None:
            g.query = runner.start(g.build(), g.name, g.mode, g.sink, "asap" if g.live else "catch_up", g.checkpoint,
                                   g.name, state_partitions=g.state_partitions)
    for g in groups:
        if g.live:
            g.query.processAllAvailable()
        else:
            g.query.awaitTermination()
        if g.query.exception() is not None:
            raise RuntimeError(f"{g.name}: {g.query.exception()}")
        if not recorder.wait(str(g.query.runId), last_batch(g.query.lastProgress) if g.live else None, 60):
            raise TimeoutError(f"no progress of {g.name}")
    by_name = {g.name: g for g in groups}
    for row in recorder.flush():
        metrics = json.loads(row["observed"] or "{}").get(row["query"]) or {}
        g = by_name.get(row["query"])
        if g is not None:
            g.consumed.update({p: int(metrics.get(f"p{p}") or 0) for p in range(TOPIC_PARTITIONS)})


def last_batch(progress) -> int:
    """The last batch a live query has run (-1: none).  A query that waits
    leaves a progress too, every ten seconds: under the number of the batch to
    come, without ``addBatch``, and the listener is not told of it."""
    if progress is None:
        return -1
    ran = "addBatch" in (progress["durationMs"] or {})
    return progress["batchId"] if ran else progress["batchId"] - 1


def ticks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TICK_SCHEMA).parquet(f"{root}/ticks")


def offsets(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OFFSET_SCHEMA).parquet(f"{root}/offsets")


def finalized(spark: SparkSession, root: str) -> DataFrame:
    """Closed windows with the watermark of the batch that emitted them: the
    stamped rows of stream Q-A joined with the listener's progress."""
    marks = (spark.read.parquet(f"{root}/progress").where(F.col("query") == "stream-qa")
             .groupBy("batch_id").agg(F.max(F.to_timestamp("watermark")).alias("watermark"),
                                      F.max("duration_ms").alias("batch_ms")))
    rows = spark.read.parquet(f"{root}/results/qa")
    return rows.join(F.broadcast(marks), "batch_id").withColumn(
        "window_end", F.col("window_start") + F.expr("INTERVAL 1 MINUTE"))
