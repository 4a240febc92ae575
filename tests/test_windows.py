"""Q-C operators against brute force on small fixtures."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from freshstream.operators.overwin import hopping, over_range

BASE = dt.datetime(2024, 1, 1)


def fixture_rows(n=600, seed=7, span_s=3 * 3600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # clustered times with exact duplicates and bucket-edge values
        t = BASE + dt.timedelta(milliseconds=rnd.randrange(0, span_s * 1000))
        if i % 50 == 0:
            t = BASE + dt.timedelta(hours=1)  # exactly on a bucket edge
        if i % 97 == 0:
            t = BASE + dt.timedelta(hours=1) - dt.timedelta(minutes=5)
        rows.append((str(i), rnd.choice(["a", "b", "c"]), t,
                     Decimal(rnd.randrange(1, 100000)) / 100))
    # one region holding most rows (hot key)
    rows += [(f"h{i}", "hot", BASE + dt.timedelta(seconds=i * 3), Decimal("1.00"))
             for i in range(900)]
    return rows


def brute(rows, w=dt.timedelta(minutes=5)):
    out = {}
    for eid, reg, t, a in rows:
        frame = [(t2, a2) for _, r2, t2, a2 in rows if r2 == reg and t - w <= t2 <= t]
        out[eid] = (len(frame), sum(x for _, x in frame), max(x for x, _ in frame))
    return out


@pytest.mark.parametrize("slice_micros,stretch", [(1_000_000, 3600), (1_000_000, 2), (7_000_000, 5),
                                                   (3_600_000_000, 3600), (1_000, 100)])
def test_over_range_exact(spark, monkeypatch, slice_micros, stretch):
    """Exact for any slice width, wider or narrower than the frame."""
    from freshstream.operators import overwin
    monkeypatch.setattr(overwin, "SLICES_PER_STRETCH", stretch)
    rows = fixture_rows()
    df = spark.createDataFrame(rows, "event_id STRING, region STRING, event_time TIMESTAMP, "
                                     "amount DECIMAL(12,2)")
    got = {r["event_id"]: (r["event_count"], r["total_amount"], r["max_event_time"])
           for r in over_range(df, slice_micros=slice_micros).collect()}
    assert got == brute(rows)


def test_over_range_nulls_and_repeats(spark):
    """NULL regions are one partition, NULL times peers of each other, NULL
    amounts are skipped, repeated rows are counted and returned."""
    t = lambda s: BASE + dt.timedelta(seconds=s)
    rows = [("1", "a", t(0), None), ("2", "a", t(10), Decimal("2.00")), ("2", "a", t(10), Decimal("2.00")),
            ("3", None, t(5), Decimal("1.00")), ("4", None, t(305), Decimal("1.50")), ("5", None, t(306), None),
            ("6", "a", None, Decimal("7.00")), ("7", "a", None, Decimal("8.00")), ("8", None, None, None),
            (None, "a", t(20), Decimal("4.00"))]
    df = spark.createDataFrame(rows, "event_id STRING, region STRING, event_time TIMESTAMP, "
                                     "amount DECIMAL(12,2)")
    got = sorted((r.event_id or "-", r.event_count, r.total_amount, r.max_event_time)
                 for r in over_range(df).collect())
    D = Decimal
    assert got == [("-", 3, D("8.00"), t(20)), ("1", 1, None, t(0)), ("2", 3, D("4.00"), t(10)),
                   ("2", 3, D("4.00"), t(10)), ("3", 1, D("1.00"), t(5)), ("4", 2, D("2.50"), t(305)),
                   ("5", 2, D("1.50"), t(306)), ("6", 2, D("15.00"), None), ("7", 2, D("15.00"), None),
                   ("8", 1, None, None)]
    assert over_range(df.limit(0)).count() == 0


def test_over_range_is_linear_in_a_dense_frame(spark):
    """All rows of one region inside one 5-minute frame: twice the rows take
    about twice the time (a frame recomputed per row would take four times)."""
    import time

    def seconds(n):
        df = spark.range(n).select(
            F.col("id").cast("string").alias("event_id"), F.lit("a").alias("region"),
            F.timestamp_micros(F.lit(1_700_000_100_000_000) + F.col("id") * F.lit(299_000_000 // n)).alias("event_time"),
            F.lit(1).cast("decimal(12,2)").alias("amount"))
        at = time.perf_counter()
        top = over_range(df).agg(F.max("event_count").alias("c"), F.sum("event_count").alias("s")).first()
        assert top.c == n and top.s == n * (n + 1) // 2
        return time.perf_counter() - at

    seconds(20_000)
    small, large = seconds(250_000), seconds(500_000)
    assert large < 3.2 * small + 2


def test_hopping_equals_builtin_window(spark):
    rows = fixture_rows(300)
    df = spark.createDataFrame(rows, "event_id STRING, region STRING, event_time TIMESTAMP, "
                                     "amount DECIMAL(12,2)")
    builtin = (df.groupBy(F.window("event_time", "5 minutes", "10 seconds"), "region")
               .agg(F.count(F.lit(1)).alias("event_count"),
                    F.sum("amount").cast("decimal(22,2)").alias("total_amount"),
                    F.max("event_time").alias("max_event_time"))
               .select(F.col("window.start").alias("window_start"), "region", "event_count",
                       "total_amount", "max_event_time",
                       F.col("window.end").alias("window_end")))
    mine = hopping(df)
    assert mine.exceptAll(builtin).count() == 0
    assert builtin.exceptAll(mine).count() == 0


def test_over_range_plan_splits_hot_region(spark):
    rows = fixture_rows(50)
    df = spark.createDataFrame(rows, "event_id STRING, region STRING, event_time TIMESTAMP, "
                                     "amount DECIMAL(12,2)")
    plan = over_range(df)._jdf.queryExecution().executedPlan().toString()
    # every window over rows is partitioned by (region, slice), never by region alone
    assert "hashpartitioning(_p" in plan and "Window [" in plan
    for line in plan.splitlines():
        if "Window [" in line and "_q" in line:
            assert "_s#" in line


def test_two_level_scans_cross_midnight(spark):
    from freshstream.operators.scan import running, suffix_min_from
    rnd = random.Random(3)
    ts = sorted({BASE + dt.timedelta(minutes=rnd.randrange(0, 4 * 1440)) for _ in range(300)}
                | {BASE + dt.timedelta(days=1) - dt.timedelta(minutes=1),
                   BASE + dt.timedelta(days=1)})
    rows = [(("a" if i % 3 else "b"), t, rnd.randrange(0, 1000)) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k STRING, t TIMESTAMP, v LONG")
    got = {(r["k"], r["t"]): r["m"] for r in
           running(df, ["k"], "t", F.col("v"), "m", "max").collect()}
    want = {(k, t): max(v2 for k2, t2, v2 in rows if k2 == k and t2 <= t) for k, t, _ in rows}
    assert got == want
    got_s = {(r["k"], r["t"]): r["s"] for r in
             running(df, ["k"], "t", F.col("v"), "s", "sum").collect()}
    want_s = {(k, t): sum(v2 for k2, t2, v2 in rows if k2 == k and t2 <= t) for k, t, _ in rows}
    assert got_s == want_s
    pts = spark.createDataFrame([(t + dt.timedelta(minutes=2),) for _, t, _ in rows], "p TIMESTAMP")
    got_m = {r["p"]: r["mn"] for r in
             suffix_min_from(pts, "p", df, "t", "v", "mn").collect()}
    want_m = {}
    for _, t, _ in rows:
        p = t + dt.timedelta(minutes=2)
        later = [v for _, t2, v in rows if t2 >= p]
        want_m[p] = min(later) if later else None
    assert got_m == want_m


def test_both_plans_of_the_range_frame_agree(spark):
    from freshstream.operators import overwin
    rows = fixture_rows() + [("n1", None, BASE, Decimal("1.00")), ("n2", "a", None, Decimal("2.00")),
                             ("n3", "a", None, None), ("n3", "a", None, None), ("n4", None, None, Decimal("3.00"))]
    df = spark.createDataFrame(rows, "event_id STRING, region STRING, event_time TIMESTAMP, amount DECIMAL(12,2)")
    pairs, slices = overwin.over_pairs(df), over_range(df, most_rows=10)
    assert pairs.exceptAll(slices).count() == 0 and slices.exceptAll(pairs).count() == 0
    assert pairs.count() == len(rows)
    assert over_range(df.limit(0)).count() == 0


def test_pair_plan_has_one_scan_and_one_exchange(spark):
    from conftest import SF_SMALL
    from freshstream.operators import overwin
    from freshstream.schema import transactions
    text = overwin.over_pairs(transactions(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in text


PRUNED = ["q1_regional", "ingest_rate", "last_5min", "current_minute", "recent_buckets", "qc_rescan"]


@pytest.mark.parametrize("name", PRUNED)
def test_time_probes_prune_partitions(spark, name):
    """A filter on the day folders, and one pushed to the files left."""
    from conftest import SF_SMALL
    from freshstream.plans import load_all
    df = load_all()[0][name](spark, SF_SMALL)
    scan = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    assert len(scan) == 1
    filters = scan[0].split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in filters and "GreaterThanOrEqual(event_time" in scan[0]


def test_clock_reads_the_newest_days(spark):
    from conftest import SF_SMALL
    from freshstream.operators.clock import clock
    from freshstream.plans.batch import daily_table
    from freshstream.tables import daily
    path = daily_table(spark, SF_SMALL)
    assert daily.newest_ingest(spark, path) == clock(spark, SF_SMALL)
    assert len(daily.days(spark, path)) >= 29
