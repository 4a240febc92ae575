"""Decoding and bad-row policy on hand-made messages (FIXTURES section 1)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from freshstream.schema import transactions
from freshstream.sources import ingest as I
from freshstream.tables import formats

SMOKE = ('{"event_id":"smoke-1","user_id":42,"amount":99.99,"region":"us-east-1",'
         '"event_type":"purchase","event_time":"2024-01-01T00:00:00.000Z"}')


def msg(event_id="e", amount="12.34", event_time="2024-01-01T00:00:30.000Z", extra=""):
    a = "" if amount is None else f'"amount":{amount},'
    t = "" if event_time is None else f'"event_time":"{event_time}",'
    return (f'{{"event_id":"{event_id}","user_id":7,{a}{t}"region":"eu-west-1",'
            f'"event_type":"view"{extra}}}')


ROWS = [
    (SMOKE, "ok"),
    (msg("missing-amount", amount=None), "missing_field"),
    (msg("amount-text", amount='"n/a"'), "corrupt"),
    ("not json at all", "corrupt"),
    ("", "corrupt"),
    (msg("no-z", event_time="2024-01-01T00:00:30.000"), "ok"),
    (msg("junk-time", event_time="yesterday"), "bad_time"),
    (msg("overflow", amount="12345678901.00"), "corrupt"),
    (msg("dup", amount="1.00"), "ok"),
    (msg("dup", amount="2.00"), "ok"),
    (msg("edge-start", event_time="2024-01-01T00:01:00.000Z"), "ok"),
    (msg("edge-end", event_time="2024-01-01T00:01:59.999Z"), "ok"),
]


@pytest.fixture(scope="module")
def decoded(spark):
    recs = spark.createDataFrame(
        [(str(i), v, 0, i, dt.datetime(2024, 1, 1, 0, 5)) for i, (v, _) in enumerate(ROWS)],
        "key STRING, value STRING, partition INT, offset BIGINT, timestamp TIMESTAMP")
    return I.decode_json(recs).orderBy("offset").collect()


def test_status_per_row(decoded):
    assert [r["status"] for r in decoded] == [s for _, s in ROWS]


def test_values_exact(decoded):
    smoke = decoded[0]
    assert smoke["amount"] == Decimal("99.99")
    assert smoke["event_time"] == dt.datetime(2024, 1, 1, 0, 0, 0)
    no_z = decoded[5]
    assert no_z["event_time"] == dt.datetime(2024, 1, 1, 0, 0, 30)
    assert decoded[1]["amount"] is None


def test_policy_split(spark, decoded):
    recs = spark.createDataFrame([(v,) for v, _ in ROWS], "value STRING").select(
        F.lit("k").alias("key"), "value", F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"),
        F.current_timestamp().alias("timestamp"))
    good, bad = I.apply_policy(I.decode_json(recs), "quarantine")
    n_bad = sum(1 for _, s in ROWS if s in I.BAD)
    assert bad.count() == n_bad
    assert good.count() == len(ROWS) - n_bad
    assert I.check_error_budget(I.decode_json(recs), n_bad) == n_bad
    with pytest.raises(I.ErrorBudgetExceeded):
        I.check_error_budget(I.decode_json(recs), n_bad - 1)


def test_minute_boundaries(spark):
    from freshstream.operators.regional import minute_buckets
    rows = [("a", dt.datetime(2024, 1, 1, 0, 1, 0)), ("b", dt.datetime(2024, 1, 1, 0, 1, 59, 999000)),
            ("c", dt.datetime(2024, 1, 1, 0, 2, 0))]
    df = spark.createDataFrame(rows, "event_id STRING, event_time TIMESTAMP").select(
        "event_id", "event_time", F.lit("r").alias("region"),
        F.lit(1).cast("decimal(12,2)").alias("amount"))
    got = {r["window_start"].minute: r["event_count"] for r in minute_buckets(df).collect()}
    assert got == {1: 2, 2: 1}


def test_bulk_delimited_roundtrip(spark, workdir):
    from freshstream.schema import transactions
    from conftest import SF_SMALL
    txn = transactions(spark, SF_SMALL)
    path = f"{workdir}/bulk"
    formats.write_delimited(txn, path, sep=formats.BULK_SEP)
    back = formats.read_delimited(spark, path, sep=formats.BULK_SEP)
    assert back.exceptAll(txn).count() == 0 and txn.exceptAll(back).count() == 0


def test_keyed_layout_keeps_order_and_splits_hot_key(spark):
    from freshstream.operators.logs import keyed_layout
    t = transactions(spark, SF_SMALL)
    hot = t.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7))
                       .otherwise(F.col("user_id")))
    rows = (keyed_layout(hot, parts=8).withColumn("p", F.spark_partition_id())
            .select("user_id", "event_time", "event_id", "p").collect())
    assert len(rows) == t.count()
    seq = {}
    for r in rows:
        seq.setdefault(r.user_id, []).append((r.p, r.event_time, r.event_id))
    for v in seq.values():
        assert [x[1:] for x in v] == sorted(x[1:] for x in v)
        assert [x[0] for x in v] == sorted(x[0] for x in v)
    assert len({x[0] for x in seq[7]}) > 1
