"""Operators over a record log (key, value, partition, offset, timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import parse_event_time


def producer_high_mark(records: DataFrame) -> DataFrame:
    """Last message of every partition -> its event time -> max over partitions.

    ``max_by`` is an aggregate with a partial step, so a partition holding a
    third of the log is combined map-side; one row per partition is shuffled."""
    last = (records.groupBy("partition")
            .agg(F.max("offset").alias("last_offset"),
                 F.max_by("value", "offset").alias("last_value")))
    et = parse_event_time(F.get_json_object("last_value", "$.event_time"))
    return last.agg(F.max(et).alias("producer_max_event_time"),
                    F.count(F.lit(1)).alias("partitions"),
                    F.sum("last_offset").alias("offset_sum"))


def tail_per_partition(records: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` messages of every partition.

    Spark plans ``row_number() <= n`` as a WindowGroupLimit that trims each
    task to ``n`` rows per partition *before* the shuffle, so a hot partition
    never moves more than ``n`` rows per task."""
    w = Window.partitionBy("partition").orderBy(F.desc("offset"))
    return (records.withColumn("rn", F.row_number().over(w))
            .where(F.col("rn") <= n)
            .select("partition", "offset", "key"))


def per_key_summary(decoded: DataFrame) -> DataFrame:
    """Per message key: its partition(s), count and offset / time ranges."""
    return (decoded.groupBy("key", "partition")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
                 F.min("event_time").alias("first_event_time"),
                 F.max("event_time").alias("last_event_time")))


def keyed_layout(df: DataFrame, key: str = "user_id", parts: int | None = None) -> DataFrame:
    """Keyed partitioning of events that keeps each key's order.

    Range-partitioned on (key, event_time, event_id) and sorted: a key's
    messages are contiguous and in order, within one partition or - for a
    key too large for one - across adjacent ones, so a hot key is split
    rather than written by a single task."""
    cols = [key, "event_time", "event_id"]
    d = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    return d.sortWithinPartitions(*cols)
