"""Delimited-text load formats (CSV with ``\\N`` nulls, ``\\x01``-separated bulk files).

Timestamps travel as text in the source form (``...SSS'Z'``) and are parsed
back with the tolerant parser, so a round trip is exact to the millisecond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import format_event_time, parse_event_time

TEXT_SCHEMA = ("event_id STRING, user_id BIGINT, amount DECIMAL(12,2), region STRING, "
               "event_type STRING, event_time STRING, ingest_time STRING")

BULK_SEP = "\x01"


def write_delimited(txn: DataFrame, path: str, sep: str = ",", null_value: str = "\\N",
                    mode: str = "errorifexists") -> None:
    (txn.select("event_id", "user_id", "amount", "region", "event_type",
                format_event_time(F.col("event_time")).alias("event_time"),
                format_event_time(F.col("ingest_time")).alias("ingest_time"))
     .write.mode(mode).option("sep", sep).option("nullValue", null_value)
     .option("header", "false").csv(path))


def read_delimited(spark: SparkSession, path: str, sep: str = ",",
                   null_value: str = "\\N") -> DataFrame:
    raw = (spark.read.schema(TEXT_SCHEMA).option("sep", sep).option("nullValue", null_value)
           .option("mode", "PERMISSIVE").csv(path))
    return raw.select("event_id", "user_id", "amount", "region", "event_type",
                      parse_event_time(F.col("event_time")).alias("event_time"),
                      parse_event_time(F.col("ingest_time")).alias("ingest_time"))
