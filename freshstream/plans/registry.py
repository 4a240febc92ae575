"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle (if any) is an
ANSI SQL string over the supplied tables; ``TXN`` expands to the typed
``transactions`` view so the SQL stays readable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRANSACTIONS_SQL
from ..session import ensure_semantics, work_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TXN_CTE = f"transactions AS ({TRANSACTIONS_SQL})"
# Replay clock of the oracle side: when the newest row became visible.
AS_OF_SQL = "(SELECT max(ingest_time) FROM transactions)"


# What the damaged feed (``records_from_transactions(dirty=True)``) leaves.
DAMAGED_CTE = """damaged AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'error' AND user_id % 5 = 2 THEN NULL ELSE amount END AS amount,
         region, event_type, event_time, ingest_time
  FROM transactions WHERE event_type <> 'error' OR user_id % 5 IN (2, 4))"""


def with_txn(sql: str, *ctes: str) -> str:
    """Prefix ``sql`` with the transactions view (and extra CTEs)."""
    return "WITH " + ",\n".join([TXN_CTE, *ctes]) + "\n" + sql


def as_output(df: DataFrame) -> DataFrame:
    """Session-zone timestamps -> TIMESTAMP_NTZ so results compare as UTC
    wall-clock values in any client."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """What a table built from the events in this session hangs on: folder,
    application, work folder, size and time of the files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (sf_dir, spark.sparkContext.applicationId, work_root(spark),
            fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime())


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_semantics(spark)
            return as_output(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
