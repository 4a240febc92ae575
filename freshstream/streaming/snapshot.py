"""Start positions ``full`` and ``latest`` of a consumer.

``latest`` follows the log from its end; ``full`` first takes a snapshot - all
chunks up to that end, as one batch job without admission limits - and then
follows.  Both hang on one boundary: the log's end when the consumer first
starts, kept in its checkpoint (``event_log.start_boundary``).  The snapshot reads
chunks up to it, the stream chunks after it, so every row is taken exactly
once whenever chunks land and whenever the consumer restarts: an unfinished
snapshot is written again under the same batch id, a finished one is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists
from ..sources import event_log as EL
from . import runner

#: Batch id of a snapshot, before all ids of the stream.
SNAPSHOT = -1


def follow(spark: SparkSession, log: str, name: str, rows: Callable[[DataFrame], DataFrame],
           sink: Callable[[DataFrame, int], None], checkpoint: str, start: str = "full", mode: str = "append",
           preset: str = "replay", rows_per_file: int | None = None):
    """Start (or restart) a consumer at ``full`` or ``latest``; returns the
    StreamingQuery.  ``rows`` turns records into the rows of ``sink``."""
    if start not in ("full", "latest"):
        raise ValueError(start)
    boundary = EL.start_boundary(spark, log, checkpoint)
    done = f"{checkpoint}/snapshot"
    if start == "full" and not path_exists(spark, f"{done}/_SUCCESS"):
        sink(rows(EL.read_chunks(spark, log, boundary)), SNAPSHOT)
        spark.range(1).write.mode("overwrite").parquet(done)
    stream = rows(EL.stream_log(spark, log, start="latest", after_chunk=boundary, preset=preset,
                                rows_per_file=rows_per_file))
    return runner.start(stream, name, mode, sink, preset, checkpoint)
