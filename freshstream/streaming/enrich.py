"""Ingest-time enrichment with dimensions that change.

A stream-static join reads its static side when the query starts and shuffles an
unsplit key where it is not broadcast.  Here the join runs per micro-batch
(``foreachBatch``): the dimension is looked up anew for every batch - the version
current when the batch runs - and the batch, being bounded, takes the batch join
of ``operators.joins.enrich``: a broadcast behind the size check, the skew-split
join beyond it, so a user with a third of the rows spans tasks.

``publish`` writes a dimension as a new version; readers take the newest complete
one, so a version that is being written is not seen.  A replayed batch rewrites
its folder (with the version then current).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import joins as J


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a dimension, oldest first (a listing)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(p) or []
                  if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def publish(dim: DataFrame, path: str) -> int:
    n = max(versions(dim.sparkSession, path), default=-1) + 1
    dim.write.mode("overwrite").parquet(f"{path}/version={n}")
    return n


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={versions(spark, path)[-1]}")


def enrich_sink(path: str, dimensions: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]],
                max_rows: int = J.BROADCAST_MAX_ROWS):
    """foreachBatch writer of enriched rows; ``dimensions`` gives customer,
    nation and region as they are now."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = J.enrich(batch, *dimensions(batch.sparkSession), max_rows)
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write
