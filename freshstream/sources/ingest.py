"""Typed ingest of log records: JSON / CSV decoding and the bad-row policy.

Decoding is one ``from_json`` / ``from_csv`` call with the declared schema
(PERMISSIVE, corrupt text captured), then ``try_to_timestamp`` for the event
time.  Nothing leaves the JVM; a row's fate is a column (``status``), so the
policy is just a filter or a split:

  ok             all fields present, time parsed
  missing_field  valid JSON, a required field absent (kept with NULL, as the
                 reference's decoders do)
  bad_time       event_time present but unparsable
  corrupt        not JSON, or a field of the wrong type / out of range

Policies: ``drop`` keeps ok + missing_field rows and silently drops the rest;
``quarantine`` returns the rest as a side table; ``fail_over_n`` raises when
a batch holds more than ``n`` bad rows (the stop-on-error-rate behaviour; a
restarted stream resumes from its checkpoint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import parse_event_time
from ..schema import RAW_EVENT_DDL

BAD = ("corrupt", "bad_time")


class ErrorBudgetExceeded(RuntimeError):
    pass


def decode_json(records: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """records(key, value, partition, offset, timestamp) -> typed rows + status.

    ``ingest_time`` defaults to the record's append timestamp (deterministic
    in replays); pass ``F.current_timestamp()`` to stamp processing time."""
    parsed = F.from_json(F.col("value"), RAW_EVENT_DDL + ", _corrupt STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    stamp = ingest_time if ingest_time is not None else F.col("timestamp")
    j = records.select("value", "partition", "offset", stamp.alias("ingest_time"),
                       parsed.alias("j"))
    return _typed(j, "j")


def _typed(j: DataFrame, s: str) -> DataFrame:
    et = parse_event_time(F.col(f"{s}.event_time"))
    status = (
        F.when(F.col(f"{s}._corrupt").isNotNull() | F.col(f"{s}.event_id").isNull(), "corrupt")
        .when(F.col(f"{s}.event_time").isNotNull() & et.isNull(), "bad_time")
        .when(F.col(f"{s}.user_id").isNull() | F.col(f"{s}.amount").isNull()
              | F.col(f"{s}.region").isNull() | F.col(f"{s}.event_type").isNull()
              | F.col(f"{s}.event_time").isNull(), "missing_field")
        .otherwise("ok"))
    return j.select(
        F.col(f"{s}.event_id").alias("event_id"),
        F.col(f"{s}.user_id").alias("user_id"),
        F.col(f"{s}.amount").alias("amount"),
        F.col(f"{s}.region").alias("region"),
        F.col(f"{s}.event_type").alias("event_type"),
        et.alias("event_time"),
        F.col("ingest_time"),
        F.col("partition"), F.col("offset"),
        status.alias("status"),
        F.col("value").alias("raw"),
    )


CSV_COLUMNS = "event_id STRING, user_id BIGINT, amount DECIMAL(12,2), region STRING, " \
              "event_type STRING, event_time STRING"


def decode_csv(records: DataFrame, sep: str = ",", null_value: str = "\\N") -> DataFrame:
    """CSV-valued records -> typed rows + status (same contract as JSON)."""
    parsed = F.from_csv(F.col("value"), CSV_COLUMNS + ", _corrupt STRING",
                        {"sep": sep, "nullValue": null_value, "mode": "PERMISSIVE",
                         "columnNameOfCorruptRecord": "_corrupt"})
    j = records.select("value", "partition", "offset", F.col("timestamp").alias("ingest_time"),
                       parsed.alias("j"))
    return _typed(j, "j")


TYPED_COLUMNS = ["event_id", "user_id", "amount", "region", "event_type", "event_time",
                 "ingest_time"]


def apply_policy(decoded: DataFrame, policy: str = "drop") -> tuple[DataFrame, DataFrame | None]:
    """Split decoded rows by policy -> (good typed rows, bad rows or None)."""
    good = decoded.where(~F.col("status").isin(*BAD)).select(*TYPED_COLUMNS)
    if policy == "drop":
        return good, None
    bad = decoded.where(F.col("status").isin(*BAD)).select(
        "raw", "partition", "offset", "ingest_time", "status")
    return good, bad


def check_error_budget(decoded: DataFrame, max_bad: int) -> int:
    """``fail_over_n``: count bad rows of one batch, raise past ``max_bad``.

    Meant for one micro-batch inside ``foreachBatch``; the count is a
    distributed aggregate, only the number reaches the driver."""
    n = decoded.where(F.col("status").isin(*BAD)).count()
    if n > max_bad:
        raise ErrorBudgetExceeded(f"{n} malformed rows in batch (limit {max_bad})")
    return n
