"""Exact stream duplicate suppression, and reconciliation by digest."""

import datetime as dt
import pathlib
import random

from pyspark.sql import functions as F

from freshstream.operators import digest as D
from freshstream.streaming import dedup
from freshstream.streaming.dedup import dedup_sink, known_rows, unseen

SCHEMA = "event_id string, event_time timestamp, value int, offset long"
T0 = dt.datetime(2024, 1, 1, 12)


def batch(spark, rows):
    return spark.createDataFrame([(i, None if m is None else T0 + dt.timedelta(minutes=m), v, o)
                                  for i, m, v, o in rows], SCHEMA)


def content(spark, path):
    return sorted(((r.event_id, r.value) for r in spark.read.parquet(f"{path}/rows").collect()), key=repr)


def test_copies_of_any_age_go_and_late_rows_stay(spark, workdir):
    """In one batch, in the next, an hour late, days late; late originals; rows
    without a time; NULL keys; a replayed batch; an empty batch."""
    write = dedup_sink(workdir)
    feed = [
        [("a", 0, 1, 0), ("b", 1, 2, 1), ("a", 0, 9, 2), ("n", None, 3, 3), (None, 2, 4, 4)],
        [("b", 1, 9, 5), ("c", 90, 5, 6), ("n", None, 9, 7), (None, 2, 9, 8)],
        [("a", 0, 9, 9), ("late", -600, 6, 10), ("d", 95, 7, 11), ("c", 90, 9, 12)],
        [],
        [("late", -600, 9, 13), ("far", 5000, 8, 14), ("b", 1, 9, 15)],
    ]
    for i, rows in enumerate(feed):
        write(batch(spark, rows), i)
    write(batch(spark, feed[2]), 2)                      # once more after a crash
    want = [("a", 1), ("b", 2), ("n", 3), (None, 4), ("c", 5), ("late", 6), ("d", 7), ("far", 8)]
    assert content(spark, workdir) == sorted(want, key=repr)


def test_random_feed_equals_first_arrivals(spark, workdir):
    rnd, write, seen, offset = random.Random(5), dedup_sink(workdir), {}, 0
    times = {f"e{i}": rnd.randrange(0, 2000) for i in range(120)}
    for b in range(5):
        rows = []
        for _ in range(60):
            k = f"e{min(119, int(rnd.expovariate(1 / 20)) + 15 * b)}"
            rows.append((k, times[k], offset, offset))
            seen.setdefault(k, offset)
            offset += 1
        rnd.shuffle(rows)
        write(batch(spark, rows).repartition(3), b)
    assert content(spark, workdir) == sorted(((k, v) for k, v in seen.items()), key=repr)


def files(path):
    return len(list(pathlib.Path(path.removeprefix("file:")).glob("rows/batch_id=*/event_hour=*/*.parquet")))


def test_an_hour_is_one_file_however_many_tasks(spark, workdir, monkeypatch):
    rows = [(f"x{m}", m % 600, m, m) for m in range(3000)]          # ten hours
    spark.conf.set("spark.sql.adaptive.enabled", "false")           # as in a stream
    try:
        dedup_sink(f"{workdir}/one")(batch(spark, rows).repartition(8), 0)
        monkeypatch.setattr(dedup, "HOUR_ROWS", 100)                # 300 an hour: three tasks each, if dealt apart
        dedup_sink(f"{workdir}/full")(batch(spark, rows).repartition(8), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert files(f"{workdir}/one") == 10
    assert 10 < files(f"{workdir}/full") <= 30
    assert content(spark, f"{workdir}/full") == content(spark, f"{workdir}/one") and len(rows) == 3000
    assert len(content(spark, f"{workdir}/one")) == 3000


def test_only_the_hours_of_the_rows_are_read(spark, workdir):
    write = dedup_sink(workdir)
    write(batch(spark, [(f"x{m}", m, m, m) for m in range(0, 6000, 50)]), 0)
    rows = batch(spark, [("x100", 100, 0, 0), ("new", 110, 0, 1)]).withColumn(
        "event_hour", F.date_format("event_time", "yyyyMMddHH"))
    left = unseen(rows, known_rows(spark, f"{workdir}/rows", 1), "event_id", True)
    assert [r.event_id for r in left.collect()] == ["new"]
    text = unseen(rows, known_rows(spark, f"{workdir}/rows", 1), "event_id", True) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "event_hour" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(event_time" in text


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, w string")


def test_removed_changed_and_repeated_keys_are_named(spark):
    a = table(spark, [(str(i), i, "x") for i in range(200)] + [(None, 1, "n"), ("r", 1, None), ("r", 1, None)])
    b = table(spark, [(str(i), i if i != 7 else -7, "x") for i in range(200) if i != 33]
              + [(None, 1, "n"), ("r", 1, None), ("extra", 0, "e")])
    got = {r.k: (r.left_rows, r.right_rows, r.status) for r in D.reconcile_by_digest(a, b, "k", buckets=64).collect()}
    assert got == {"7": (1, 1, "different"), "33": (1, 0, "missing_right"), "extra": (0, 1, "missing_left"),
                   "r": (2, 1, "different")}


def test_equal_tables_cost_one_aggregate(spark):
    a = table(spark, [(str(i), i, None) for i in range(300)])
    assert D.differing(a, a.orderBy(F.desc("v")).repartition(5), "k", ["k", "v", "w"]) == []
    assert D.reconcile_by_digest(a, a, "k").count() == 0
    assert D.reconcile_by_digest(a.limit(0), a.limit(0), "k").count() == 0


def test_only_differing_buckets_are_compared(spark):
    a = table(spark, [(str(i), i, "x") for i in range(2000)])
    b = a.where("k <> '5'")
    wrong = D.differing(a, b, "k", a.columns, 256)
    assert len(wrong) == 1
    part = a.where(D.bucket_of("k", 256).isin(wrong)).count()
    assert 1 <= part < 40


def test_null_differs_from_every_value(spark):
    a, b = table(spark, [("1", None, "x")]), table(spark, [("1", 0, "x")])
    c, d = table(spark, [("1", 42, None)]), table(spark, [("1", None, None)])
    assert D.reconcile_by_digest(a, b, "k").count() == 1 and D.reconcile_by_digest(c, d, "k").count() == 1
