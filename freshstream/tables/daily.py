"""Reading the day-partitioned append table by time.

The append sink (``streaming.maintained.append_by_day_sink``) lays a table out as
``batch_id=<n>/event_date=<day>/``.  Spark prunes partitions by predicates on the
partition column only, so a predicate on ``event_time`` is turned into one on
``event_date`` as well (``since``), and the newest days come from the listing: the
clock of a query (newest ingest time) reads the last two days of the table, not
the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clock import lit_ts


def days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days the table has partitions of, oldest first (a listing)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*/event_date=*")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {s.getPath().getName().split("=")[1] for s in fs.globStatus(p) or []}
    return sorted(dt.date.fromisoformat(n) for n in names if n[:1].isdigit())


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def since(table: DataFrame, lo: dt.datetime, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``event_time >= lo``: a partition filter and a pushed-down one."""
    kept = table.where((F.col("event_date") >= F.lit(lo.date())) & (F.col("event_time") >= lit_ts(lo)))
    return kept.drop("event_date", "batch_id") if columns is None else kept.select(*columns)


def newest_ingest(spark: SparkSession, path: str) -> dt.datetime | None:
    """max(ingest_time), from the two newest days (a row becomes visible
    within seconds of its event, so no older day can hold it)."""
    found = days(spark, path)
    if not found:
        return None
    t = read(spark, path).where(F.col("event_date") >= F.lit(found[-2:][0]))
    return t.agg(F.max(F.col("ingest_time").cast("timestamp_ntz")).alias("m")).first()["m"]
