"""The query clock (``as_of``).

Live, ``as_of`` is the wall clock.  In replays and tests it is the moment
the newest row became visible: ``max(ingest_time)``.  It is resolved to a
literal *before* the main query is planned, so time predicates built from it
are plain comparisons that Catalyst pushes into the Parquet scan (a scalar
sub-query would not be pushed).  ``AS_OF`` in the session's settings names the
clock: ``now``, an ISO instant (neither reads any data), or ``replay``, the
default.  A replay clock reads one column for ``max(ts)`` and, since a row
becomes visible within ``MAX_DELAY`` of its event time, the rest only of the
last seconds before it (a pushed-down filter).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


AS_OF = "freshstream.as_of"
MAX_DELAY = dt.timedelta(seconds=5)


def replay_clock(txn: DataFrame, column: str = "ingest_time") -> dt.datetime:
    """max(column) of a typed table as a python datetime (UTC, naive)."""
    row = txn.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("m")).first()
    return row["m"]


def clock(spark: SparkSession, sf_dir: str) -> dt.datetime:
    """The query clock of this session (see the module's text)."""
    from ..schema import table, transactions
    as_of = spark.conf.get(AS_OF, "replay")
    if as_of == "now":
        return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if as_of != "replay":
        return dt.datetime.fromisoformat(as_of)
    newest = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp_ntz").alias("m")).first()["m"]
    if newest is None:
        return dt.datetime(1970, 1, 1)
    since = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - MAX_DELAY
    return replay_clock(transactions(spark, sf_dir, since=since))


def lit_ts(x: dt.datetime):
    return F.lit(x).cast("timestamp_ntz").cast("timestamp")
