"""Retention of maintained aggregates and of tiered hot batches: folders stay
bounded over many batches, answers do not change."""

import datetime as dt
import os

from pyspark.sql import functions as F

from freshstream.tables import keyed as K
from freshstream.tables import retention
from freshstream.tables import tiering as TR

T0 = dt.datetime(2024, 1, 1)


def minute_rows(spark, minutes, value):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(minutes=m), "eu", 1, value, T0 + dt.timedelta(minutes=m, seconds=5)) for m in minutes],
        "window_start timestamp, region string, event_count bigint, total_amount int, max_event_time timestamp") \
        .withColumn("total_amount", F.col("total_amount").cast("decimal(22,2)")).coalesce(1)


def folders(path, start):
    return [f for f in os.listdir(path) if f.startswith(start)]


def test_partials_over_a_hundred_batches(spark, workdir):
    """Batch i brings minute i and a late row for minute i - 3; the live windows
    are those of the last 2 hours at any time; upkeep every 10 batches."""
    merge = K.merge_partials(["window_start", "region"])
    most = 0
    for i in range(100):
        minute_rows(spark, [i * 3, max(0, i * 3 - 9)], i).write.parquet(f"{workdir}/batch_id={i}")
        if i % 10 == 9:
            as_of = T0 + dt.timedelta(minutes=i * 3 + 1)
            before = {(r.window_start, r.event_count) for r in
                      retention.read_partials(spark, workdir, merge, as_of).collect()}
            retention.maintain_partials(spark, workdir, merge, as_of)
            after = {(r.window_start, r.event_count) for r in
                     retention.read_partials(spark, workdir, merge, as_of).collect()}
            assert before == after and len(after) <= 41
            most = max(most, len(folders(workdir, "batch_id")))
            want = {}
            for k in range(i + 1):
                for m in (k * 3, max(0, k * 3 - 9)):
                    want[T0 + dt.timedelta(minutes=m)] = want.get(T0 + dt.timedelta(minutes=m), 0) + 1
            edge = as_of - dt.timedelta(hours=2)
            assert after == {(w, n) for w, n in want.items() if w >= edge}
    assert most <= 20 and len(folders(f"{workdir}/_base", "upto")) <= 2
    base = max(folders(f"{workdir}/_base", "upto"), key=lambda f: int(f.split("=")[1]))
    assert spark.read.parquet(f"{workdir}/_base/{base}").count() <= 41   # expired windows are gone for good


def test_hot_batches_go_once_they_are_tiered(spark, workdir):
    sink = TR.hot_sink(workdir)
    rows = lambda i: spark.createDataFrame(
        [(str(i % 37), "eu", T0 + dt.timedelta(seconds=i), i)],
        "event_id string, region string, event_time timestamp, offset bigint").coalesce(1)
    for i in range(40):
        sink(rows(i), i)
        if i % 5 == 4:
            TR.tier(spark, workdir)
            TR.expire_hot(spark, workdir)
            ids = {r.event_id: r.offset for r in TR.read_union(spark, workdir).collect()}
            assert len(ids) == min(37, i + 1)
            assert TR.read_union(spark, workdir).count() == i + 1      # nothing lost, nothing twice
            assert len(folders(f"{workdir}/hot", "batch_id")) <= 10
            assert len(folders(f"{workdir}/hot_commits", "batch_id")) <= 10
    sink(rows(40), 40)
    assert TR.read_union(spark, workdir).count() == 41
    assert TR.expire_hot(spark, workdir) == 0
    assert TR.tier(spark, workdir) is not None and TR.tier(spark, workdir) is None


def test_nothing_to_expire(spark, workdir):
    assert TR.expire_hot(spark, workdir) == 0
    TR.hot_sink(workdir)(spark.range(1).select(F.lit("a").alias("event_id"), F.lit("eu").alias("region"),
                                               F.current_timestamp().alias("event_time")), 0)
    TR.tier(spark, workdir)
    assert TR.expire_hot(spark, workdir) == 0          # one epoch of grace
    assert len(folders(f"{workdir}/hot", "batch_id")) == 1
