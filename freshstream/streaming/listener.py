"""Live measurement feed: streaming progress -> rows of a table.

A ``StreamingQueryListener`` receives every micro-batch's progress on the
driver (a few hundred bytes each) and only keeps it in memory; whoever runs
the queries writes it out with ``flush`` (after a tick, or or from a
thread of its own), so nothing is written on the listener bus:

  progress(query, run_id, batch_id, observed_at, input_rows, input_rows_per_s,
           processed_rows_per_s, duration_ms, watermark, observed, source,
           start_offset, end_offset, latest_offset)

``observed`` holds the metrics of ``DataFrame.observe`` as JSON.
``offset_log_from_progress`` turns topic offsets (JSON ``{topic: {partition:
offset}}``) into ``offset_log`` rows: ``end_offset`` = the log end
(latestOffset), ``committed_offset`` = what the batch consumed (endOffset).
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PROGRESS_SCHEMA = ("query STRING, run_id STRING, batch_id BIGINT, observed_at STRING, "
                   "input_rows BIGINT, input_rows_per_s DOUBLE, processed_rows_per_s DOUBLE, "
                   "duration_ms BIGINT, watermark STRING, observed STRING, source STRING, start_offset STRING, "
                   "end_offset STRING, latest_offset STRING")
FIELDS = [c.split()[0] for c in PROGRESS_SCHEMA.split(", ")]


class ProgressRecorder(StreamingQueryListener):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows: list[tuple] = []
        self.ended: set[str] = set()
        self.last_batch: dict[str, int] = {}
        self.change = threading.Condition()
        self.closing = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = json.loads(event.progress.json)
        rows = [(p.get("name"), p.get("runId"), p.get("batchId"), p.get("timestamp"),
                 p.get("numInputRows"), p.get("inputRowsPerSecond"), p.get("processedRowsPerSecond"),
                 (p.get("durationMs") or {}).get("triggerExecution"),
                 (p.get("eventTime") or {}).get("watermark"), _text(p.get("observedMetrics")),
                 s.get("description"), _text(s.get("startOffset")), _text(s.get("endOffset")),
                 _text(s.get("latestOffset"))) for s in p.get("sources", []) or [{}]]
        with self.change:
            self.rows += rows
            self.last_batch[p.get("runId")] = p.get("batchId")
            self.change.notify_all()

    def onQueryTerminated(self, event):
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def wait(self, run_id: str, batch_id: int | None = None, timeout_s: float | None = None) -> bool:
        """Until the progress of a run has arrived - all of it if the run has
        ended, else up to ``batch_id`` (events come on a bus, in order, some
        time after the fact)."""
        with self.change:
            return self.change.wait_for(
                lambda: run_id in self.ended if batch_id is None else self.last_batch.get(run_id, -1) >= batch_id,
                timeout_s)

    def flush(self) -> list[dict]:
        """Append what has arrived to the table; returns it."""
        with self.change:
            rows, self.rows = self.rows, []
        if rows:
            (self.spark.createDataFrame(rows, PROGRESS_SCHEMA)
             .write.mode("append").parquet(self.path))
        return [dict(zip(FIELDS, r)) for r in rows]

    def flush_from_thread(self, seconds: float) -> threading.Thread:
        """For queries that run on: flush from a thread until ``close``."""
        def run():
            while not self.closing.wait(seconds):
                self.flush()
        t = threading.Thread(target=run, daemon=True)
        t.start()
        return t

    def close(self) -> None:
        self.closing.set()
        self.flush()


def _text(v):
    return None if v is None else (v if isinstance(v, str) else json.dumps(v))


def offset_log_from_progress(progress: DataFrame) -> DataFrame:
    """Progress rows of a topic source -> offset_log rows."""
    m = "MAP<STRING, MAP<STRING, BIGINT>>"
    end = F.from_json("latest_offset", m)
    com = F.from_json("end_offset", m)
    x = progress.select(
        F.to_timestamp("observed_at").alias("observed_at"), F.col("query").alias("group_id"),
        F.explode(end).alias("topic", "parts"), com.alias("committed"))
    y = x.select("observed_at", "group_id", "topic", "committed",
                 F.explode("parts").alias("partition", "end_offset"))
    return y.select("observed_at", "group_id", "topic",
                    F.col("partition").cast("int").alias("partition"), "end_offset",
                    F.col("committed")[F.col("topic")][F.col("partition")]
                    .alias("committed_offset"))
