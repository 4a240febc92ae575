"""Tiering, union read, compaction, upsert layout, retention, catalog, sizes."""

import contextlib
import datetime as dt
import io
import os
from decimal import Decimal

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL
from freshstream.functions.format import readable_quantity, readable_size
from freshstream.operators.dedup import latest_per_key
from freshstream.schema import TABLES, transactions
from freshstream.tables import keyed as K
from freshstream.tables import retention
from freshstream.tables import tiering as TR

COLS = ["event_id", "user_id", "amount", "region", "event_type", "event_time", "ingest_time"]


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_union_equals_full_table_at_every_epoch(spark, workdir):
    txn = transactions(spark, SF_SMALL).withColumn("offset", F.col("event_id").cast("long"))
    days = [dt.datetime(2024, 1, d) for d in (8, 15, 22, 31)]
    sink = TR.hot_sink(workdir)
    lo = dt.datetime(2023, 1, 1)
    for i, hi in enumerate(days):
        part = txn.where((F.col("event_time") >= F.lit(lo)) & (F.col("event_time") < F.lit(hi)))
        sink(part, i)
        lo = hi
        seen = txn.where(F.col("event_time") < F.lit(hi))
        assert _same(TR.read_union(spark, workdir, "event_id").select(*COLS), seen.select(*COLS))
        TR.tier(spark, workdir)
        assert _same(TR.read_union(spark, workdir, "event_id").select(*COLS), seen.select(*COLS))
        assert _same(TR.read_cold(spark, workdir).select(*COLS), seen.select(*COLS))
    assert TR.tier_epochs(spark, workdir).count() == 4


def test_external_table_sees_new_epochs(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    TR.hot_sink(workdir)(txn.where(F.col("event_type") == "view"), 0)
    TR.tier(spark, workdir)
    name = TR.register_external(spark, "ext_cold_test", workdir)
    n1 = spark.table(name).count()
    TR.hot_sink(workdir)(txn.where(F.col("event_type") != "view"), 1)
    TR.tier(spark, workdir)
    TR.register_external(spark, name, workdir)
    assert (n1, spark.table(name).count()) == (
        txn.where(F.col("event_type") == "view").count(), txn.count())


def test_compaction_keeps_answer(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    for i, et in enumerate(["view", "click", "error", "purchase", "signup"]):
        (txn.where(F.col("event_type") == et).groupBy("region")
         .agg(F.count(F.lit(1)).alias("event_count"),
              F.sum("amount").cast("decimal(22,2)").alias("total_amount"),
              F.max("event_time").alias("max_event_time"))
         .write.parquet(f"{workdir}/batch_id={i}"))
    merge = K.merge_partials(["region"])
    before = K.read_merged(spark, workdir, merge)
    K.compact(spark, workdir, merge)
    assert _same(before, K.read_merged(spark, workdir, merge))


def test_batch_landing_during_compaction_counts_once(spark, workdir):
    """A batch committed between the compaction's start and its marker stays a
    delta; an unfinished batch is not folded; retention keeps the answer."""
    def batch(i, rows=10):
        spark.range(rows).select(F.lit("a").alias("region"), F.lit(1).cast("long").alias("event_count"),
                                 F.lit(1).cast("decimal(22,2)").alias("total_amount"),
                                 F.current_timestamp().alias("max_event_time")) \
            .write.mode("overwrite").parquet(f"{workdir}/batch_id={i}")

    merge = K.merge_partials(["region"])
    total = lambda: K.read_merged(spark, workdir, merge).first().event_count
    batch(0)
    batch(1)

    def late(df):
        batch(2)
        return df

    assert K.compact(spark, workdir, merge, layout=late) == 1
    assert total() == 30
    batch(3)
    os.remove(f"{workdir}/batch_id=3/_SUCCESS")          # still being written
    assert K.compact(spark, workdir, merge) == 2 and K.committed_upto(spark, workdir) == 2
    assert total() == 40
    batch(3)
    batch(4)
    assert K.compact(spark, workdir, merge) == 4 and K.compact(spark, workdir, merge) is None
    assert K.expire_folded(spark, workdir, keep_bases=2) > 0
    assert total() == 50 and not os.path.exists(f"{workdir}/batch_id=1")


def test_late_split_keeps_rows_without_time(spark, workdir):
    from freshstream.streaming.maintained import late_split_sink
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    sink = late_split_sink(workdir, 60)
    sink(spark.createDataFrame([("a", t(30))], "event_id STRING, event_time TIMESTAMP"), 0)
    sink(spark.createDataFrame([("b", t(31)), ("l", t(1)), ("n", None)],
                               "event_id STRING, event_time TIMESTAMP"), 1)
    ids = lambda k: sorted(r.event_id for r in spark.read.parquet(f"{workdir}/{k}").collect())
    assert ids("main") == ["a", "b", "n"] and ids("late") == ["l"]


def test_average_skips_null_amounts(spark):
    from freshstream.operators.regional import regional_aggregate
    df = spark.createDataFrame([("a", Decimal(10)), ("a", Decimal(20)), ("a", None), ("b", None)], "region STRING, amount DECIMAL(12,2)")
    got = {r.region: (r.cnt, r.avg_amount) for r in regional_aggregate(df).collect()}
    assert got == {"a": (3, 15.0), "b": (1, None)}


def test_reconcile_reports_a_missing_key(spark):
    from freshstream.operators.dedup import reconcile
    append = spark.createDataFrame([("a",), ("b",), ("b",)], "event_id STRING")
    r = reconcile(append, append.where("event_id <> 'a'").distinct()).first()
    assert (r.missing_in_pk, r.missing_in_append, r.duplicate_rows) == (1, 0, 1)


def test_latest_per_key_hot_key(spark):
    rows = [("k", i, i * 10) for i in range(5000)] + [("j", 1, 5)]
    df = spark.createDataFrame(rows, "key STRING, offset LONG, v LONG")
    got = {r["key"]: r["v"] for r in latest_per_key(df, "key", ["offset"]).collect()}
    assert got == {"k": 49990, "j": 5}
    plan = latest_per_key(df, "key", ["offset"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan  # map-side combine before the shuffle


def test_hash_bucket_layout_colocates(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    K.hash_bucket_layout("event_id", 8)(txn).write.partitionBy("bucket").parquet(workdir + "/b")
    t = spark.read.parquet(workdir + "/b")
    assert t.groupBy("event_id").agg(F.count_distinct("bucket").alias("n")) \
        .where("n > 1").count() == 0
    assert t.select("bucket").distinct().count() == 8
    txn.write.bucketBy(8, "event_id").sortBy("event_id").saveAsTable("bucketed_txn_test")
    assert spark.table("bucketed_txn_test").count() == txn.count()


def test_retention_drops_old_hours(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    retention.write_hourly(txn, workdir + "/t")
    as_of = dt.datetime(2024, 1, 30, 12)
    dropped = retention.expire(spark, workdir + "/t", as_of, 2)
    assert dropped
    left = spark.read.parquet(workdir + "/t")
    assert left.where(F.col("event_time") < F.lit(dt.datetime(2024, 1, 30, 10))).count() == 0


def test_table_sizes_match_footers(spark):
    from freshstream.operators.sizes import table_sizes
    got = {r["table"]: r for r in
           table_sizes(spark, {t: f"{SF_SMALL}/{t}.parquet" for t in TABLES}).collect()}
    for t in ("events", "lineitem"):
        c, u, n = duckdb.sql(
            f"SELECT sum(total_compressed_size), sum(total_uncompressed_size), "
            f"(SELECT count(*) FROM '{SF_SMALL}/{t}.parquet') "
            f"FROM parquet_metadata('{SF_SMALL}/{t}.parquet')").fetchall()[0]
        assert (got[t]["compressed_bytes"], got[t]["uncompressed_bytes"], got[t]["rows"]) == (c, u, n)


def test_readable_formats(spark):
    df = spark.createDataFrame([(5,), (1536,), (1234567,)], "x LONG")
    got = df.select(readable_quantity(F.col("x")).alias("q"),
                    readable_size(F.col("x")).alias("s")).collect()
    assert [(r["q"], r["s"]) for r in got] == [
        ("5.00", "5.00 B"), ("1.54 thousand", "1.50 KiB"), ("1.23 million", "1.18 MiB")]


def test_union_read_as_stream(spark, workdir):
    from freshstream.streaming import runner
    txn = transactions(spark, SF_SMALL).select(*COLS)
    sink = TR.hot_sink(workdir)
    sink(txn.where(F.col("event_time") < F.lit(dt.datetime(2024, 1, 20))), 0)
    TR.tier(spark, workdir)
    sink(txn.where(F.col("event_time") >= F.lit(dt.datetime(2024, 1, 20))), 1)
    s = TR.stream_union(spark, workdir, txn.schema)
    out = runner.run_to_table(s, "union-stream", "append", path=f"{workdir}/u")
    got = spark.read.parquet(out).drop("batch_id").select(*COLS)
    assert _same(got, txn)


def test_skew_split_join_exact(spark):
    from freshstream.operators.joins import hot_keys, skew_split_join
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)],
                                 "k LONG, v LONG")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 3000, 2)], "rk LONG, name STRING")
    assert 1 in hot_keys(left, "k", fraction=0.1, sample=0.5)
    got = skew_split_join(left, right, "k", "rk", "left", max_rows=10)
    want = left.join(right, left["k"] == right["rk"], "left")
    assert _same(got.select("k", "v", "name"), want.select("k", "v", "name"))


def test_broadcast_bound_counts_bytes(spark):
    """Few rows, wide values: the byte bound, not the row bound, refuses."""
    from freshstream.operators.joins import bounded_broadcast, measure
    narrow = spark.createDataFrame([(i, "x") for i in range(10)], "k INT, s STRING")
    wide = spark.createDataFrame([(i, "x" * 10_000) for i in range(10)], "k INT, s STRING")
    rows, size = measure(narrow)
    assert rows == 10 and size == 10 * (16 + 8 + (1 + 8))
    assert measure(wide)[1] > 100_000
    probe = spark.range(10).withColumnRenamed("id", "k")
    for dim, broadcast in ((narrow, True), (wide, False)):
        j = probe.join(bounded_broadcast(dim, max_rows=100, max_bytes=50_000), "k")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            j.explain("extended")
        assert ("strategy=broadcast" in buf.getvalue()) == broadcast
        assert j.count() == 10


def test_read_latest_equals_merge_across_base_and_deltas(spark, workdir):
    """Keys updated after a compaction: the delta wins, untouched base rows
    stay, new keys appear - same rows as the full merge, base not shuffled."""
    def batch(i, rows):
        (spark.createDataFrame(rows, "event_id STRING, offset LONG, amount LONG")
         .write.parquet(f"{workdir}/batch_id={i}"))
    batch(0, [(f"e{k}", k, k) for k in range(100)])
    batch(1, [(f"e{k}", 100 + k, -k) for k in range(0, 100, 3)])  # updates
    merge = K.merge_latest("event_id", ("batch_id", "offset"))
    K.compact(spark, workdir, merge, K.hash_bucket_layout("event_id", 8))
    batch(2, [(f"e{k}", 200 + k, 1000 + k) for k in range(0, 100, 5)]   # after compaction
          + [("e7", 300, 7), ("e7", 301, 77), ("new", 302, 1)])
    cols = ["event_id", "amount"]
    got = K.read_latest(spark, workdir, "event_id").select(*cols)
    want = K.read_merged(spark, workdir, merge).select(*cols)
    assert _same(got, want)
    amounts = {r["event_id"]: r["amount"] for r in got.collect()}
    assert amounts["e5"] == 1005 and amounts["e3"] == -3 and amounts["e7"] == 77
    assert amounts["e1"] == 1 and amounts["new"] == 1 and len(amounts) == 101
    # a second compaction through the same reader keeps the answer
    K.compact(spark, workdir, merge, K.hash_bucket_layout("event_id", 8),
              reader=lambda sp, p: K.read_latest(sp, p, "event_id"))
    assert _same(K.read_latest(spark, workdir, "event_id").select(*cols), want)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        got.explain()
    plan = buf.getvalue()
    # the base is scanned straight into a broadcast anti join; only the
    # deltas pass through hash exchanges
    assert "LeftAnti, BuildRight" in plan and "SortMergeJoin" not in plan
    lines = plan.splitlines()
    base_scans = [i for i, line in enumerate(lines) if "FileScan" in line and "_base" in line]
    assert base_scans
    for i in base_scans:   # above the base scan: the anti join, no exchange
        above = next(line for line in reversed(lines[:i])
                     if "Join" in line or "Exchange" in line)
        assert "LeftAnti" in above
