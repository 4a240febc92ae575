"""Declared schemas and the typed ``transactions`` view.

Schemas are fixed and declared, never inferred.  The raw message has six
flat fields; the typed table adds the pipeline's ``ingest_time``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's domains).
# Regions, in the order the event generator lists them:
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "eu-central-1",
           "ap-southeast-1", "ap-northeast-1", "sa-east-1"]
# Event types of the raw message:
EVENT_TYPES = ["purchase", "refund", "view", "add_to_cart", "checkout", "login"]
# Text form of event_time at the source: ISO-8601, milliseconds, UTC 'Z'.
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# Probe duration histogram bounds, seconds (+Inf is implicit):
HISTOGRAM_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
# Number of topic partitions of the event log.
TOPIC_PARTITIONS = 12
# ---------------------------------------------------------------------------

# Raw JSON message.  amount is exact DECIMAL(12,2); event_time stays text
# until parsed (it may carry 'Z' or be junk).
RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("region", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.StringType()),
])
RAW_EVENT_DDL = ("event_id STRING, user_id BIGINT, amount DECIMAL(12,2), region STRING, "
                 "event_type STRING, event_time STRING")

# Typed table.
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", T.DecimalType(12, 2)),
    T.StructField("region", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("ingest_time", T.TimestampType()),
])

# Record envelope of the event log (one row per message).
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def region_of(user_id: Column) -> Column:
    """Deterministic region of a user: the fixed list indexed by user_id % 7."""
    arr = F.array(*[F.lit(r) for r in REGIONS])
    return F.element_at(arr, (F.pmod(user_id, F.lit(len(REGIONS))) + 1).cast("int"))


def ms_floor(ts: Column) -> Column:
    """Truncate to milliseconds (the reference's TIMESTAMP(3))."""
    return F.date_trunc("millisecond", ts)


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Typed ``transactions`` rows from the supplied ``events`` table.

    ingest_time is the event time plus a deterministic 0-4999 ms pipeline
    delay so lag metrics have something to measure."""
    et = ms_floor(F.col("ts")).cast("timestamp")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        region_of(F.col("user_id")).alias("region"),
        F.col("event_type"),
        et.alias("event_time"),
        F.timestamp_add("MILLISECOND", F.pmod(F.col("event_id") * 37, F.lit(5000)), et)
        .alias("ingest_time"),
    )


def transactions(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """The typed table over ``events``.

    ``since`` / ``until`` (python datetimes, millisecond aligned) are applied
    to the raw ``ts`` column *before* projection, so they reach the Parquet
    scan as pushed filters (ms-aligned bounds make ``ts >= x`` and
    ``ms_floor(ts) >= x`` equivalent)."""
    ev = table(spark, sf_dir, "events")
    if since is not None:
        ev = ev.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        ev = ev.where(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return transactions_from_events(ev)


# DuckDB form of the same view (used by oracle SQL).
TRANSACTIONS_SQL = """
SELECT CAST(event_id AS VARCHAR) AS event_id, user_id,
       CAST(value AS DECIMAL(12,2)) AS amount,
       CASE user_id % 7 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'us-west-2' WHEN 2 THEN 'eu-west-1'
            WHEN 3 THEN 'eu-central-1' WHEN 4 THEN 'ap-southeast-1' WHEN 5 THEN 'ap-northeast-1'
            ELSE 'sa-east-1' END AS region,
       event_type,
       date_trunc('millisecond', ts) AS event_time,
       date_trunc('millisecond', ts) + to_milliseconds((event_id * 37) % 5000) AS ingest_time
FROM events
"""
