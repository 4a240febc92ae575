"""Streaming: stream equals batch, restart from checkpoint, consumer groups,
watermark drops, processing-time windows, presets."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL
from freshstream.operators.regional import minute_buckets
from freshstream.schema import transactions, transactions_from_events
from freshstream.sources import event_log as EL
from freshstream.streaming import maintained as M
from freshstream.streaming import runner
from freshstream.tables import keyed as K


def _log(spark, workdir, txn, chunks=3, sub="a"):
    EL.write_log(EL.records_from_transactions(txn), f"{workdir}/log/{sub}", chunks)
    return f"{workdir}/log"


def test_restart_resumes_same_rows(spark, workdir):
    """Stop after part of the log, add more, resume: partial sums = batch."""
    txn = transactions(spark, SF_SMALL)
    cut = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp")
    _log(spark, workdir, txn.where(F.col("ingest_time") < cut), 2, "a")
    path, ckpt = f"{workdir}/partials", f"{workdir}/ckpt"
    for sub in ("a", "b"):
        if sub == "b":
            _log(spark, workdir, txn.where(F.col("ingest_time") >= cut), 2, "b")
        typed = M.typed_stream(spark, f"{workdir}/log", files_per_trigger=1)
        q = runner.start(typed, "restart", "append", M.partial_sink(path, M.partials_qb),
                         checkpoint=ckpt)
        q.awaitTermination(120)
        assert q.exception() is None
    merged = K.read_merged(spark, path, K.merge_partials(["region"]))
    expect = (txn.groupBy("region").agg(F.count(F.lit(1)).alias("event_count"),
                                        F.sum("amount").cast("decimal(22,2)").alias("total_amount"),
                                        F.max("event_time").alias("max_event_time")))
    assert merged.exceptAll(expect).count() == 0 and expect.exceptAll(merged).count() == 0
    assert spark.read.parquet(path).select("batch_id").distinct().count() == 4


def test_replayed_batch_is_idempotent(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    sink = M.partial_sink(f"{workdir}/p", M.partials_qb)
    sink(txn, 0)
    sink(txn, 0)  # the same batch again after a crash
    merged = K.read_merged(spark, f"{workdir}/p", K.merge_partials(["region"]))
    assert merged.agg(F.sum("event_count")).first()[0] == txn.count()


def test_independent_consumer_groups(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    log = _log(spark, workdir, txn)
    counts = []
    for g in ("g1", "g2"):
        out = runner.run_to_table(M.typed_stream(spark, log), g, "append",
                                  path=f"{workdir}/{g}", checkpoint=f"{workdir}/{g}-ckpt")
        counts.append(spark.read.parquet(out).count())
    assert counts == [txn.count(), txn.count()]


@pytest.mark.parametrize("restart_each_chunk", [False, True])
def test_watermark_drops_late_rows(spark, workdir, restart_each_chunk):
    txn = transactions(spark, SF_SMALL)
    segs = (EL.segments(EL.records_from_transactions(txn.where(F.col("event_type") != "signup")), 3)
            + [EL.records_from_transactions(txn.where(F.col("event_type") == "signup"))])
    log = f"{workdir}/log"
    ckpt = runner.replay(segs, log, lambda: M.qa_windows(M.typed_stream(spark, log), "1 minute"),
                         "wm", "append", runner.batch_writer(f"{workdir}/qa"),
                         restart_each_chunk=restart_each_chunk)
    kept = spark.read.parquet(f"{workdir}/qa").agg(F.sum("event_count")).first()[0]
    # late rows are judged against the watermark of the batch before them;
    # windows are emitted once the final watermark passes their end
    wm1 = txn.where(F.col("event_type") != "signup").agg(F.max("event_time")).first()[0] \
        - dt.timedelta(minutes=1)
    wm_final = txn.agg(F.max("event_time")).first()[0] - dt.timedelta(minutes=1)
    end = F.date_trunc("minute", F.col("event_time")) + F.expr("INTERVAL 1 MINUTE")
    expect = txn.where((end <= F.lit(wm_final)) & (
        (F.col("event_type") != "signup") | (F.col("event_time") >= F.lit(wm1)))).count()
    closed = txn.where(end <= F.lit(wm_final)).count()
    assert kept == expect and kept < closed


def test_processing_time_windows_count_everything(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    log = _log(spark, workdir, txn)
    out = runner.run_to_table(M.qa_processing_time(M.typed_stream(spark, log)), "pt", "update")
    latest = (spark.read.parquet(out).groupBy("window_start", "region")
              .agg(F.max_by("event_count", "batch_id").alias("c")))
    assert latest.agg(F.sum("c")).first()[0] == txn.count()


def test_update_stream_equals_batch(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    log = f"{workdir}/log"
    out = runner.replay_to_table(EL.segments(EL.records_from_transactions(txn), 4), log,
                                 lambda: M.qa_windows(M.typed_stream(spark, log)), "qa", "update")
    assert spark.read.parquet(out).select("batch_id").distinct().count() >= 4
    got = (spark.read.parquet(out).groupBy("window_start", "region")
           .agg(F.max_by("event_count", "batch_id").alias("event_count")))
    want = minute_buckets(txn).select("window_start", "region", "event_count")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_presets_start_and_stop(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    log = _log(spark, workdir, txn, chunks=1)
    for preset in ("low_latency", "balanced", "throughput"):
        q = runner.start(M.typed_stream(spark, log), f"preset-{preset}", "append",
                         runner.batch_writer(f"{workdir}/{preset}"), preset=preset)
        q.processAllAvailable()
        q.stop()
        assert spark.read.parquet(f"{workdir}/{preset}").count() == txn.count()


def test_error_budget_stops_then_resumes(spark, workdir):
    from freshstream.sources import ingest as I
    txn = transactions(spark, SF_SMALL)
    EL.write_log(EL.records_from_transactions(txn, dirty=True), f"{workdir}/log/a", 2)
    ckpt, out = f"{workdir}/ckpt", f"{workdir}/out"
    q = runner.start(M.decoded_stream(spark, f"{workdir}/log"), "guard", "append",
                     M.guarded_sink(out, 0), checkpoint=ckpt)
    with pytest.raises(Exception, match="malformed"):
        q.awaitTermination(120)
    q = runner.start(M.decoded_stream(spark, f"{workdir}/log"), "guard", "append",
                     M.guarded_sink(out, 10_000), checkpoint=ckpt)
    q.awaitTermination(120)
    assert q.exception() is None
    good = I.apply_policy(I.decode_json(EL.records_from_transactions(txn, dirty=True)))[0]
    assert spark.read.parquet(out).count() == good.count()


def test_progress_listener_and_offset_log(spark, workdir):
    from freshstream.streaming.listener import ProgressRecorder, offset_log_from_progress
    rec = ProgressRecorder(spark, f"{workdir}/progress")
    spark.streams.addListener(rec)
    try:
        txn = transactions(spark, SF_SMALL)
        log = _log(spark, workdir, txn, chunks=3)
        runner.run_to_table(M.typed_stream(spark, log), "listened", "append")
        import time
        total = None
        for _ in range(30):  # listener events arrive asynchronously
            time.sleep(1)
            rec.flush()
            try:
                total = spark.read.parquet(f"{workdir}/progress") \
                    .agg(F.sum("input_rows")).first()[0]
            except Exception:
                continue
            if total == txn.count():
                break
    finally:
        spark.streams.removeListener(rec)
    assert total == txn.count()
    topic = spark.createDataFrame(
        [("g", "2024-01-01T00:00:00.000Z", '{"t":{"0":5,"1":7}}', '{"t":{"0":9,"1":7}}')],
        "query STRING, observed_at STRING, end_offset STRING, latest_offset STRING")
    got = {(r["partition"], r["end_offset"], r["committed_offset"])
           for r in offset_log_from_progress(topic).collect()}
    assert got == {(0, 9, 5), (1, 7, 7)}


def test_replay_deadline_stops_the_query(spark, workdir):
    txn = transactions(spark, SF_SMALL)
    segs = EL.segments(EL.records_from_transactions(txn), 2)
    log = f"{workdir}/log"
    with pytest.raises(TimeoutError):
        runner.replay(segs, log, lambda: M.qb_running_total(M.typed_stream(spark, log)),
                      "deadline", "update", runner.batch_writer(f"{workdir}/out"), timeout_s=0)
    assert not spark.streams.active


def test_a_chunk_of_a_time_ordered_table_is_written_by_several_tasks(spark, workdir):
    events = spark.range(0, 40_000, 1, 4).selectExpr(
        "id AS event_id", "CAST(timestamp_micros(id * 1000000) AS timestamp_ntz) AS ts", "id % 100 AS user_id",
        "'view' AS event_type", "1.5D AS value")
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(key, "10k")
    try:
        parts = [EL.append_chunk(EL.records_from_transactions(transactions_from_events(c)), f"{workdir}/log", i)
                 for i, c in enumerate(EL.event_chunks(events, 4))]
    finally:
        spark.conf.unset(key)
    held = [EL.read_log(spark, p).groupBy(F.input_file_name()).count().collect() for p in parts]
    assert all(max(r["count"] for r in files) < 0.6 * sum(r["count"] for r in files) for files in held)
    assert sum(r["count"] for files in held for r in files) == 40_000
