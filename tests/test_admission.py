"""Admission limits of the presets and the start positions of a consumer."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from freshstream.schema import transactions
from freshstream.sources import event_log as EL
from freshstream.streaming import maintained as M
from freshstream.streaming import runner, snapshot
from freshstream.streaming.presets import PRESETS, Preset


def rows_per_batch(q):
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


def small_log(spark, workdir, rows=1200, rows_per_file=50):
    txn = transactions(spark, SF_SMALL)
    many = txn.unionByName(txn).limit(rows).repartition(4)
    EL.append_chunk(EL.records_from_transactions(many), f"{workdir}/log", 0, rows_per_file=rows_per_file)
    return f"{workdir}/log"


@pytest.mark.parametrize("preset", ["low_latency", "balanced", "throughput"])
def test_rows_per_batch_of_each_preset(spark, workdir, preset, monkeypatch):
    """A thousandth of each limit, on a log of bounded files: every batch
    holds as many whole files as the limit has room for."""
    p = PRESETS[preset]
    limit = p.rows // 1000
    monkeypatch.setitem(PRESETS, preset, Preset({"availableNow": True}, limit, p.bytes))
    rows_per_file = 20
    log = small_log(spark, workdir, rows_per_file=rows_per_file)
    q = runner.start(M.typed_stream(spark, log, preset=preset, rows_per_file=rows_per_file), "limits", "append",
                     runner.batch_writer(f"{workdir}/out"), preset=preset)
    assert q.awaitTermination(120)
    got = rows_per_batch(q)
    assert sum(got) == 1200 and max(got) <= limit
    files = limit // rows_per_file
    assert len(got) == -(-60 // files) and got[0] == min(1200, files * rows_per_file)


def test_byte_limit_where_files_are_unbounded(spark, workdir):
    log = small_log(spark, workdir, rows_per_file=100)
    size = max(r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.json").load(log).select("length").collect())
    df = (spark.readStream.format("json").schema("key string").option("recursiveFileLookup", "true")
          .options(**Preset({}, None, 2 * size).file_options()).load(log))
    q = runner.start(df, "bytes", "append", runner.batch_writer(f"{workdir}/out"))
    assert q.awaitTermination(120)
    assert sum(rows_per_batch(q)) == 1200 and max(rows_per_batch(q)) <= 300 and len(rows_per_batch(q)) >= 4


def test_options_of_the_sources():
    low = PRESETS["low_latency"]
    assert low.file_options(1000) == {"maxFilesPerTrigger": 65}
    assert low.file_options() == {"maxBytesPerTrigger": 50 << 20}
    assert low.file_options(1 << 30) == {"maxFilesPerTrigger": 1}
    assert PRESETS["balanced"].kafka_options() == {
        "maxOffsetsPerTrigger": "300000", "minOffsetsPerTrigger": "30000", "maxTriggerDelay": "5 seconds"}
    assert PRESETS["replay"].file_options(10) == {} and PRESETS["replay"].kafka_options() == {}


def append(spark, log, seq, lo, hi):
    EL.append_chunk(EL.records_from_transactions(transactions(spark, SF_SMALL).where(
        F.col("event_id").cast("long").between(lo, hi - 1))), log, seq)


def ids(spark, path, **where):
    t = spark.read.parquet(path)
    return sorted(int(r.event_id) for r in t.select("event_id").collect())


def consume(spark, workdir, start, sink=None, **kw):
    q = snapshot.follow(spark, f"{workdir}/log", "c", M.typed_rows, sink or runner.batch_writer(f"{workdir}/t"),
                        f"{workdir}/ckpt", start, **kw)
    assert q.awaitTermination(120) and q.exception() is None


def test_full_takes_every_row_once_over_the_handover(spark, workdir):
    log = f"{workdir}/log"
    append(spark, log, 0, 0, 100)
    append(spark, log, 1, 100, 150)
    consume(spark, workdir, "full")
    append(spark, log, 2, 150, 300)
    consume(spark, workdir, "full")                       # a restart moves nothing
    consume(spark, workdir, "full")
    assert ids(spark, f"{workdir}/t") == list(range(300))
    snap = spark.read.parquet(f"{workdir}/t").where(F.col("batch_id") == snapshot.SNAPSHOT)
    assert snap.count() == 150


def test_full_after_a_crash_in_the_snapshot(spark, workdir):
    """The boundary stands, chunks land, the snapshot is written again."""
    log = f"{workdir}/log"
    append(spark, log, 0, 0, 100)
    writer = runner.batch_writer(f"{workdir}/t")

    def dies(batch, batch_id):
        writer(batch.limit(10), batch_id)
        raise OSError("lost")

    with pytest.raises(OSError):
        consume(spark, workdir, "full", dies)
    append(spark, log, 1, 100, 200)
    consume(spark, workdir, "full")
    assert ids(spark, f"{workdir}/t") == list(range(200))


def test_latest_reads_only_what_comes_after(spark, workdir):
    log = f"{workdir}/log"
    append(spark, log, 0, 0, 100)
    consume(spark, workdir, "latest")
    append(spark, log, 1, 100, 130)
    consume(spark, workdir, "latest")
    append(spark, log, 2, 130, 140)
    consume(spark, workdir, "latest")
    assert ids(spark, f"{workdir}/t") == list(range(100, 140))


def test_start_on_an_empty_log(spark, workdir):
    import os
    os.makedirs(f"{workdir}/log")
    assert EL.start_boundary(spark, f"{workdir}/log", f"{workdir}/ckpt") == -1
    append(spark, f"{workdir}/log", 0, 0, 20)
    consume(spark, workdir, "full")
    assert ids(spark, f"{workdir}/t") == list(range(20))
    with pytest.raises(ValueError):
        EL.stream_log(spark, f"{workdir}/log", start="latest")
