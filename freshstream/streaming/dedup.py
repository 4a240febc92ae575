"""Exact duplicate suppression on a stream, however late a copy comes.

Spark's own streaming duplicate suppression forgets ids behind the watermark and
drops rows that come later.  Here a batch is compared with the table it is
written to, in two tiers:

  recent  rows at most ``horizon`` behind the newest event so far: compared with
          the ids of the last hours, read from their earliest event time on
          (partition and row-group pruning: what was written about that time)
  late    all other rows: compared with the ids of their own hours only

So a batch costs what was written around its own event times, not the table, and
nothing is dropped.  Copies of an event carry the event's own time (they are
found in the hour it names); of the copies in one batch the first by arrival
stays.  The table is partitioned by batch and hour, an hour of a batch is one file
unless it holds very many rows; a replayed batch compares with earlier batches only
and replaces what it wrote.

Rows without an event time are compared among themselves.  NULL keys are one key.
A key with many copies is combined in each task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import hour_key
from ..operators.joins import bounded_broadcast, fits_broadcast
from ..session import path_exists

#: Hours a batch may name before the hour filter is left to the join.
MOST_HOURS = 1000
UNTIMED = "none"
#: Rows of an hour that one task writes; a fuller hour is dealt to several.
HOUR_ROWS = 1_000_000


def first_per_key(batch: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    values = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return first.select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def known_rows(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    if not path_exists(spark, path):
        return None
    t = spark.read.option("basePath", path).parquet(path)
    return t.where(F.col("batch_id") < before).withColumn("event_hour", F.col("event_hour").cast("string"))


def unseen(rows: DataFrame, known: DataFrame | None, key: str, since: bool) -> DataFrame:
    """``rows`` whose key is not in ``known``, reading its hours only (and,
    with ``since``, nothing before the earliest of ``rows``)."""
    if known is None:
        return rows
    found = rows.groupBy("event_hour").agg(F.min("event_time").alias("t")).limit(MOST_HOURS + 1).collect()
    if not found:
        return rows
    if len(found) <= MOST_HOURS:
        known = known.where(F.col("event_hour").isin([r["event_hour"] for r in found]))
    times = [r["t"] for r in found if r["t"] is not None]
    if since and times and len(found) <= MOST_HOURS:
        known = known.where((F.col("event_time") >= F.lit(min(times))) | F.col("event_time").isNull())
    ids = known.select(F.col(key).alias("_known"))
    mine = rows.select(F.col(key).alias("_mine"))
    if fits_broadcast(mine):                  # the table's side is not shuffled
        ids = bounded_broadcast(ids.join(F.broadcast(mine), F.col("_known").eqNullSafe(F.col("_mine")), "left_semi")
                                .distinct())
    return rows.join(ids, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def by_hour(new: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """``new`` (some rows of ``batch``) with each hour in one task, so that it is
    one file; hours of more than ``HOUR_ROWS`` in several, dealt by key."""
    full = (batch.groupBy("event_hour").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOUR_ROWS)
            .select("event_hour", F.ceil(F.col("_n") / HOUR_ROWS).alias("_n")))
    piece = F.pmod(F.xxhash64(key), F.coalesce("_n", F.lit(1)))
    return new.join(F.broadcast(full), "event_hour", "left").repartition("event_hour", piece).drop("_n")


def dedup_sink(path: str, key: str = "event_id", order: tuple[str, ...] = ("offset",), horizon_minutes: int = 10):
    """foreachBatch writer: the batch's unseen rows to ``path/rows``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, None
        if path_exists(spark, f"{path}/marks"):
            mark = (spark.read.parquet(f"{path}/marks").where(F.col("batch_id") < batch_id)
                    .agg(F.max("mark").alias("m")).first()["m"])
        rows = first_per_key(batch, key, order).withColumn(
            "event_hour", F.coalesce(hour_key(F.col("event_time")), F.lit(UNTIMED))).persist()
        try:
            edge = None if mark is None else F.lit(mark).cast("timestamp") - F.make_dt_interval(
                mins=F.lit(horizon_minutes))
            late = F.lit(False) if edge is None else F.coalesce(F.col("event_time") < edge, F.lit(False))
            known = known_rows(spark, f"{path}/rows", batch_id)
            new = unseen(rows.where(~late), known, key, True)
            if edge is not None:
                new = new.unionByName(unseen(rows.where(late), known, key, False))
            (by_hour(new, rows, key).sortWithinPartitions("event_hour", "event_time")
             .write.mode("overwrite").partitionBy("event_hour").parquet(f"{path}/rows/batch_id={batch_id}"))
            (rows.agg(F.max("event_time").alias("mark"))
             .write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}"))
        finally:
            rows.unpersist()
    return write
