"""Retention (TTL) for hour-partitioned tables.

The table is partitioned by ``event_hour`` (``yyyyMMddHH``).  Expiry drops
whole partition folders older than ``as_of - hours``; readers apply the same
bound as a partition filter, so a reader never depends on when the expiry
job last ran (rows past their TTL are invisible either way).  Dropping is a
metadata operation on the file system: no data is rewritten.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import hour_key


def write_hourly(txn: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Hour-partitioned append, sorted within files by (region, event_time,
    event_id); no shuffle, so a hot hour is written by every task."""
    (txn.withColumn("event_hour", hour_key(F.col("event_time")))
     .sortWithinPartitions("event_hour", "region", "event_time", "event_id")
     .write.mode(mode).partitionBy("event_hour").parquet(path))


def _cutoff_key(as_of: dt.datetime, hours: int) -> str:
    return (as_of - dt.timedelta(hours=hours)).strftime("%Y%m%d%H")


def expire(spark: SparkSession, path: str, as_of: dt.datetime, hours: int = 2) -> list[str]:
    """Delete ``event_hour`` partitions whose hour is before as_of - hours."""
    cutoff = _cutoff_key(as_of, hours)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("event_hour=") and name.split("=", 1)[1] < cutoff:
            fs.delete(st.getPath(), True)
            dropped.append(name)
    return dropped


def read_live(spark: SparkSession, path: str, as_of: dt.datetime, hours: int = 2) -> DataFrame:
    """Rows within the TTL: a partition filter (pruned at planning time)."""
    t = spark.read.option("basePath", path).parquet(path)
    # partition values are inferred as numbers; compare as the text key
    t = t.withColumn("event_hour", F.col("event_hour").cast("string"))
    return t.where(F.col("event_hour") >= F.lit(_cutoff_key(as_of, hours)))


# -- maintained aggregates ------------------------------------------------------

def within(as_of: dt.datetime, hours: int, time_col: str = "window_start"):
    """Rows of a time-keyed aggregate that have not expired (whole minutes)."""
    edge = (as_of - dt.timedelta(hours=hours)).replace(second=0, microsecond=0)
    return lambda df: df.where(F.col(time_col) >= F.lit(edge).cast("timestamp_ntz").cast("timestamp"))


def maintain_partials(spark: SparkSession, path: str, merge, as_of: dt.datetime, hours: int = 2,
                      time_col: str = "window_start") -> int:
    """Upkeep of a partial-aggregate table: fold the batches, leave out what has
    expired, and delete what the last two bases no longer need.  Run every few
    batches, the table holds the batches of two runs and the live windows,
    however long the stream runs; returns the number of deleted folders."""
    from . import keyed as K
    K.compact(spark, path, merge, live=within(as_of, hours, time_col))
    return K.expire_folded(spark, path)


def read_partials(spark: SparkSession, path: str, merge, as_of: dt.datetime, hours: int = 2,
                  time_col: str = "window_start") -> DataFrame:
    """Merged live windows; the same answer before and after any upkeep."""
    from . import keyed as K
    return K.read_merged(spark, path, lambda df: merge(within(as_of, hours, time_col)(df)))
