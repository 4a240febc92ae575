"""Registered ingest / log queries (ops 1, 2, 6, 7, 14, 20, 23-28)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.time import parse_event_time
from ..operators import logs as L
from ..operators.clock import MAX_DELAY, clock
from ..schema import transactions
from ..session import fresh_dir
from ..sources import event_log as EL
from ..sources import ingest as I
from .registry import AS_OF_SQL, DAMAGED_CTE, register, with_txn

LOG_CTE = """log AS (
  SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id % 12 AS INTEGER) AS partition,
         CAST(event_id AS BIGINT) AS "offset", ingest_time AS "timestamp", event_time, event_id
  FROM transactions)"""


def _records(spark, sf_dir, dirty=False):
    return EL.records_from_transactions(transactions(spark, sf_dir), dirty=dirty)


@register("ingest_json", with_txn(
    "SELECT event_id, user_id, amount, region, event_type, event_time, ingest_time "
    "FROM transactions"))
def ingest_json(spark, sf_dir):
    """Log records -> from_json with the declared schema -> typed table."""
    good, _ = I.apply_policy(I.decode_json(_records(spark, sf_dir)), "drop")
    return good


@register("malformed_split", with_txn("""
SELECT status, count(*) AS rows, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM (SELECT CASE WHEN event_type <> 'error' THEN 'ok'
                  WHEN user_id % 5 IN (0, 1) THEN 'corrupt'
                  WHEN user_id % 5 = 2 THEN 'missing_field'
                  WHEN user_id % 5 = 3 THEN 'bad_time' ELSE 'ok' END AS status,
             CASE WHEN event_type = 'error' AND user_id % 5 IN (0, 1, 2) THEN NULL
                  ELSE amount END AS amount
      FROM transactions)
GROUP BY status"""))
def malformed_split(spark, sf_dir):
    """Decode a damaged feed; count rows and money per row status."""
    dec = I.decode_json(_records(spark, sf_dir, dirty=True))
    return (dec.groupBy("status")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum("amount").cast("decimal(22,2)").alias("total_amount")))


@register("q1_damaged", with_txn("""
SELECT region, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(22,2)) AS total,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_amount
FROM damaged GROUP BY region""", DAMAGED_CTE))
def q1_damaged(spark, sf_dir):
    """Q1 over the damaged feed: the average skips missing amounts."""
    from ..operators.regional import regional_aggregate
    good, _ = I.apply_policy(I.decode_json(_records(spark, sf_dir, dirty=True)), "drop")
    return regional_aggregate(good)


@register("qc_damaged", with_txn("""
SELECT event_id, region, event_time,
       count(event_id) OVER w AS event_count,
       CAST(sum(amount) OVER w AS DECIMAL(22,2)) AS total_amount,
       max(event_time) OVER w AS max_event_time
FROM damaged
WINDOW w AS (PARTITION BY region ORDER BY event_time
             RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW)""", DAMAGED_CTE))
def qc_damaged(spark, sf_dir):
    """Q-C per event over the damaged feed."""
    from ..operators.overwin import over_range
    good, _ = I.apply_policy(I.decode_json(_records(spark, sf_dir, dirty=True)), "drop")
    return over_range(good)


@register("json_paths", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_extract_string(props, '$.k') AS k_text
FROM events""")
def json_paths(spark, sf_dir):
    """JSON path extraction (get_json_object / json_tuple) on events.props."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select("event_id",
                     F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                     F.json_tuple("props", "k").alias("k_text"))


@register("parse_event_time", with_txn("""
SELECT event_id, event_time AS parsed_z, event_time AS parsed_plain,
       CAST(NULL AS TIMESTAMP) AS parsed_junk
FROM transactions"""))
def parse_event_time_q(spark, sf_dir):
    """Text -> timestamp with 'Z', without 'Z', and junk (NULL, never an error)."""
    txn = transactions(spark, sf_dir)
    et = F.col("event_time")
    return txn.select(
        "event_id",
        parse_event_time(F.date_format(et, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("parsed_z"),
        parse_event_time(F.date_format(et, "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("parsed_plain"),
        parse_event_time(F.concat(F.lit("junk-"), F.col("event_id"))).alias("parsed_junk"))


@register("scan_from_timestamp", with_txn("""
SELECT partition, count(*) AS rows, min("offset") AS first_offset, max("offset") AS last_offset
FROM log WHERE "timestamp" >= """ + AS_OF_SQL + """ - INTERVAL 7 DAY
GROUP BY partition""", LOG_CTE))
def scan_from_timestamp(spark, sf_dir):
    """Start position 'timestamp': replay from an instant (clock - 7 days)."""
    start = clock(spark, sf_dir) - dt.timedelta(days=7)
    # a record is appended within MAX_DELAY of its event: bound the scan, too
    recs = EL.records_from_transactions(transactions(spark, sf_dir, since=start - MAX_DELAY))
    return (EL.from_timestamp(recs, start).groupBy("partition")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("offset").alias("first_offset"),
                 F.max("offset").alias("last_offset")))


@register("producer_high_mark", with_txn("""
SELECT max(last_et) AS producer_max_event_time, count(*) AS partitions,
       CAST(sum(last_offset) AS BIGINT) AS offset_sum
FROM (SELECT partition, max("offset") AS last_offset,
             arg_max(event_time, "offset") AS last_et
      FROM log GROUP BY partition)""", LOG_CTE))
def producer_high_mark(spark, sf_dir):
    """Newest event time over the last message of every partition."""
    return L.producer_high_mark(_records(spark, sf_dir))


@register("result_tail", with_txn("""
SELECT partition, "offset", key FROM (
  SELECT partition, "offset", key,
         row_number() OVER (PARTITION BY partition ORDER BY "offset" DESC) AS rn
  FROM log) WHERE rn <= 50""", LOG_CTE))
def result_tail(spark, sf_dir):
    """Newest 50 messages of every partition."""
    return L.tail_per_partition(_records(spark, sf_dir), 50)


@register("per_user_order", with_txn("""
SELECT key, partition, count(*) AS events, min("offset") AS first_offset,
       max("offset") AS last_offset, min(event_time) AS first_event_time,
       max(event_time) AS last_event_time
FROM log GROUP BY key, partition""", LOG_CTE))
def per_user_order(spark, sf_dir):
    """Keyed partitioning: every user's messages sit in one partition."""
    recs = _records(spark, sf_dir)
    dec = I.decode_json(recs)
    return L.per_key_summary(dec.withColumn("key", F.col("user_id").cast("string")))


@register("ingest_csv", with_txn(
    "SELECT event_id, user_id, amount, region, event_type, event_time, ingest_time "
    "FROM transactions"))
def ingest_csv(spark, sf_dir):
    """CSV load format: write delimited text ('\\N' nulls), read it back typed."""
    from ..tables import formats
    path = fresh_dir(spark, "csv")
    txn = transactions(spark, sf_dir)
    formats.write_delimited(txn, path, sep=",")
    return formats.read_delimited(spark, path, sep=",")
