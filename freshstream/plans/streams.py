"""Registered streaming / maintained-table queries (ops 11, 12, 15, 16,
39-50, 60).  Each one replays the supplied ``events`` as a record log
through a real Structured Streaming query - producer style: append a chunk
of the log, advance the query (availableNow, same checkpoint), repeat - so
each query runs several ordered micro-batches and restarts, checkpointed
under ``spark.checkpoint.dir``; it returns the maintained table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.clock import clock
from ..operators.dedup import latest_per_key, reconcile
from ..schema import table, transactions, transactions_from_events
from ..session import fresh_dir
from ..sources import event_log as EL
from ..sources import ingest as I
from ..streaming import maintained as M
from ..streaming import runner, snapshot
from ..tables import keyed as K
from ..tables import retention
from ..tables.bucketed import BucketedTable
from .registry import AS_OF_SQL, DAMAGED_CTE, register, with_txn

# At least this many micro-batches per replay, and one per CHUNK_BYTES of input.
CHUNKS = 4
CHUNK_BYTES = 1 << 30
# Region-keyed state (7 keys): one state store per possible key is enough.
REGION_STATE_PARTITIONS = 8


def chunk_count(spark, sf_dir: str) -> int:
    """Micro-batches of a replay: by the input's size on disk."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max(CHUNKS, -(-fs.getContentSummary(path).getLength() // CHUNK_BYTES))


def feed(spark, sf_dir, kind="clean"):
    """The replay log of ``events`` as append-ordered chunks (lazy frames)."""
    txns = [transactions_from_events(e) for e in
            EL.event_chunks(table(spark, sf_dir, "events"), chunk_count(spark, sf_dir))]
    if kind == "clean":
        return [EL.records_from_transactions(t) for t in txns]
    if kind == "redelivered":
        return [EL.redelivered_records(t) for t in txns]
    if kind == "damaged":
        return [EL.records_from_transactions(t, dirty=True) for t in txns]
    if kind == "csv":
        return [EL.csv_records(t) for t in txns]
    if kind == "late":
        # on-time rows first, then every signup arrives in one late chunk
        on_time = [EL.records_from_transactions(t.where(F.col("event_type") != "signup")) for t in txns]
        late = transactions(spark, sf_dir).where(F.col("event_type") == "signup")
        return [*on_time, EL.records_from_transactions(late)]
    raise ValueError(kind)


def _stream(spark, sf_dir, name, mode, transform, sink_factory=None, kind="clean",
            keep_position=False, state_partitions=None, decode=I.decode_json):
    """Replay the feed through ``transform`` into a sink; returns the sink folder."""
    log = fresh_dir(spark, f"log-{name}")
    out = fresh_dir(spark, name)
    sink = sink_factory(out) if sink_factory else runner.batch_writer(out)
    runner.replay(feed(spark, sf_dir, kind), log,
                  lambda: transform(M.typed_stream(spark, log, keep_position=keep_position, decode=decode)),
                  name, mode, sink, state_partitions=state_partitions)
    return out


QB_SQL = with_txn("""
SELECT region, count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount,
       max(event_time) AS max_event_time
FROM transactions GROUP BY region""")

QA_ALL_SQL = with_txn("""
SELECT date_trunc('minute', event_time) AS window_start, region, count(*) AS event_count,
       CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount, max(event_time) AS max_event_time
FROM transactions GROUP BY 1, 2""")


def _latest_changes(spark, path, keys):
    """Update-mode changelog -> newest row per key (by batch_id)."""
    df = spark.read.parquet(path)
    return latest_per_key(df, keys, ["batch_id"]).drop("batch_id")


@register("qb_running_total", QB_SQL)
def qb_running_total(spark, sf_dir):
    """Q-B as a stateful streaming aggregate (update mode)."""
    out = _stream(spark, sf_dir, "qb", "update", M.qb_running_total,
                  state_partitions=REGION_STATE_PARTITIONS)
    return _latest_changes(spark, out, ["region"])


@register("qb_damaged", with_txn("""
SELECT region, count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount,
       max(event_time) AS max_event_time
FROM damaged GROUP BY region""", DAMAGED_CTE))
def qb_damaged(spark, sf_dir):
    """Q-B over the damaged feed: unreadable rows dropped, rows without an
    amount counted but not added up."""
    out = _stream(spark, sf_dir, "qb-damaged", "update", M.qb_running_total, kind="damaged",
                  state_partitions=REGION_STATE_PARTITIONS)
    return _latest_changes(spark, out, ["region"])


@register("qb_csv", with_txn("""
SELECT region, count(*) AS event_count,
       CAST(sum(CASE WHEN event_type <> 'error' THEN amount END) AS DECIMAL(22,2)) AS total_amount,
       max(event_time) AS max_event_time
FROM transactions GROUP BY region"""))
def qb_csv(spark, sf_dir):
    """Q-B over a CSV feed (``\\N`` nulls), decoded in the stream."""
    out = _stream(spark, sf_dir, "qb-csv", "update", M.qb_running_total, kind="csv",
                  state_partitions=REGION_STATE_PARTITIONS, decode=I.decode_csv)
    return _latest_changes(spark, out, ["region"])


@register("qa_final", with_txn("""
SELECT date_trunc('minute', event_time) AS window_start, region, count(*) AS event_count,
       CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount, max(event_time) AS max_event_time
FROM transactions GROUP BY 1, 2
HAVING date_trunc('minute', event_time) + INTERVAL 1 MINUTE
       <= (SELECT max(event_time) FROM transactions) - INTERVAL 1 MINUTE"""))
def qa_final(spark, sf_dir):
    """Q-A, append mode: each closed window once (watermark 1 minute)."""
    out = _stream(spark, sf_dir, "qa-final", "append", lambda t: M.qa_windows(t, "1 minute"))
    return spark.read.parquet(out).drop("batch_id")


@register("qa_partial", QA_ALL_SQL)
def qa_partial(spark, sf_dir):
    """Q-A, update mode: partial results while open; newest per window."""
    out = _stream(spark, sf_dir, "qa-partial", "update", lambda t: M.qa_windows(t, "1 minute"))
    return _latest_changes(spark, out, ["window_start", "region"])


def _partials(spark, sf_dir, name, fn):
    return _stream(spark, sf_dir, name, "append", lambda t: t,
                   sink_factory=lambda p: M.partial_sink(p, fn))


@register("qb_partials", QB_SQL)
def qb_partials(spark, sf_dir):
    """Stateless per-batch partials, merged on read (sum, sum, max)."""
    path = _partials(spark, sf_dir, "qb-partials", M.partials_qb)
    return K.read_merged(spark, path, K.merge_partials(["region"]))


@register("qa_partials", QA_ALL_SQL)
def qa_partials(spark, sf_dir):
    path = _partials(spark, sf_dir, "qa-partials", M.partials_qa)
    return K.read_merged(spark, path, K.merge_partials(["window_start", "region"]))


@register("qb_merged", QB_SQL)
def qb_merged(spark, sf_dir):
    """Partials after a background compaction: the answer is unchanged."""
    path = _partials(spark, sf_dir, "qb-merged", M.partials_qb)
    merge = K.merge_partials(["region"])
    K.compact(spark, path, merge)
    return K.read_merged(spark, path, merge)


@register("qa_merged", QA_ALL_SQL)
def qa_merged(spark, sf_dir):
    path = _partials(spark, sf_dir, "qa-merged", M.partials_qa)
    merge = K.merge_partials(["window_start", "region"])
    K.compact(spark, path, merge)
    return K.read_merged(spark, path, merge)


@register("qa_ttl", with_txn(f"""
SELECT date_trunc('minute', event_time) AS window_start, region, count(*) AS event_count,
       CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount, max(event_time) AS max_event_time
FROM transactions
WHERE date_trunc('minute', event_time) >= date_trunc('minute', {AS_OF_SQL} - INTERVAL 24 HOUR)
GROUP BY 1, 2"""))
def qa_ttl(spark, sf_dir):
    """Per-minute partials under retention (24 hours here): upkeep after every
    batch folds them and drops expired windows and folded batches."""
    merge = K.merge_partials(["window_start", "region"])

    def sink(path):
        write = M.partial_sink(path, M.partials_qa)

        def run(batch, batch_id):
            write(batch, batch_id)
            newest = batch.agg(F.max("event_time").cast("timestamp_ntz").alias("m")).first()["m"]
            if newest is not None:
                retention.maintain_partials(batch.sparkSession, path, merge, newest, 24)
        return run

    path = _stream(spark, sf_dir, "qa-ttl", "append", lambda t: t, sink_factory=sink)
    return retention.read_partials(spark, path, merge, clock(spark, sf_dir), 24)


@register("append_by_day", with_txn("""
SELECT CAST(event_time AS DATE) AS event_date, count(*) AS rows,
       CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM transactions GROUP BY 1"""))
def append_by_day(spark, sf_dir):
    """Append sink, day-partitioned and sorted; rows per day read back."""
    path = _stream(spark, sf_dir, "append", "append", lambda t: t,
                   sink_factory=M.append_by_day_sink)
    t = spark.read.option("basePath", path).parquet(path)
    return (t.groupBy("event_date")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum("amount").cast("decimal(22,2)").alias("total_amount")))


@register("fanout_counts", with_txn("""
SELECT s.sink, count(*) AS rows, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM transactions, (VALUES ('append'), ('qa_partials'), ('qb_partials')) AS s(sink)
GROUP BY s.sink"""))
def fanout_counts(spark, sf_dir):
    """One scan, one checkpoint, three sinks; each sink's totals read back."""
    def sinks(root):
        return M.fanout_sink({"append": M.append_by_day_sink(f"{root}/append"),
                              "qa": M.partial_sink(f"{root}/qa", M.partials_qa),
                              "qb": M.partial_sink(f"{root}/qb", M.partials_qb)})
    root = _stream(spark, sf_dir, "fanout", "append", lambda t: t, sink_factory=sinks)
    a = (spark.read.option("basePath", f"{root}/append").parquet(f"{root}/append")
         .agg(F.count(F.lit(1)).alias("rows"),
              F.sum("amount").cast("decimal(22,2)").alias("total_amount"))
         .withColumn("sink", F.lit("append")))
    parts = []
    for name, sub in (("qa_partials", "qa"), ("qb_partials", "qb")):
        parts.append(spark.read.parquet(f"{root}/{sub}")
                     .agg(F.sum("event_count").alias("rows"),
                          F.sum("total_amount").cast("decimal(22,2)").alias("total_amount"))
                     .withColumn("sink", F.lit(name)))
    return a.unionByName(parts[0]).unionByName(parts[1]).select("sink", "rows", "total_amount")


UPSERT_SQL = with_txn("""
SELECT event_id, user_id,
       CAST(CASE WHEN event_type = 'purchase' THEN amount + 1 ELSE amount END AS DECIMAL(12,2))
         AS amount,
       region, event_type, event_time
FROM transactions""")


def _upsert_table(spark, sf_dir, name="pk"):
    return _stream(spark, sf_dir, name, "append", lambda t: t.drop("ingest_time"),
                   kind="redelivered", keep_position=True)


def primary_key_table(spark, sf_dir, kind="redelivered", name="pk"):
    """Primary-key table on event_id, last write (by arrival) wins: 8 hash
    buckets (``tables.bucketed``).

    Stream batches land as deltas.  Half-way through the feed a compaction
    folds them into the buckets, then the stream goes on from its checkpoint;
    a read is the buckets plus the newer deltas."""
    log, path = fresh_dir(spark, f"log-{name}"), fresh_dir(spark, name)
    segs = feed(spark, sf_dir, kind)

    def build():
        return M.typed_stream(spark, log, keep_position=True)

    half = len(segs) // 2
    sink = runner.batch_writer(path)
    ckpt = runner.replay(segs[:half], log, build, name, "append", sink)
    pk = BucketedTable(spark, path, "event_id", build().schema)
    pk.compact()
    runner.replay(segs[half:], log, build, name, "append", sink, checkpoint=ckpt, first_seq=half)
    return pk


@register("upsert_latest", UPSERT_SQL)
def upsert_latest(spark, sf_dir):
    """The primary-key table's rows."""
    return primary_key_table(spark, sf_dir).read().select(
        "event_id", "user_id", "amount", "region", "event_type", "event_time")


@register("pk_join", with_txn("""
SELECT region, count(*) AS rows, CAST(count_if(event_type = 'purchase') AS BIGINT) AS corrected,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS DECIMAL(22,2)) AS correction
FROM transactions GROUP BY region"""))
def pk_join(spark, sf_dir):
    """Two primary-key tables joined on their key - the one fed once, the one
    fed at least once with corrections.  Both are compacted, so both sides are
    bucketed scans and the join needs no exchange."""
    once, again = (primary_key_table(spark, sf_dir, kind, f"pk-{kind}") for kind in ("clean", "redelivered"))
    for t in (once, again):
        t.compact()
    a = once.read().select("event_id", "region", F.col("amount").alias("first"))
    b = again.read().select("event_id", F.col("amount").alias("last"))
    j = a.join(b.hint("merge"), "event_id")
    return (j.groupBy("region")
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("first") != F.col("last")).alias("corrected"),
                 F.sum(F.col("last") - F.col("first")).cast("decimal(22,2)").alias("correction")))


@register("reconcile_pipelines", with_txn("""
SELECT CAST(count(*) + count_if(event_type = 'purchase') AS BIGINT) AS append_rows,
       count(*) AS pk_rows, count(*) AS distinct_ids,
       CAST(0 AS BIGINT) AS missing_in_pk, CAST(0 AS BIGINT) AS missing_in_append,
       CAST(count_if(event_type = 'purchase') AS BIGINT) AS duplicate_rows
FROM transactions"""))
def reconcile_pipelines(spark, sf_dir):
    """Append table vs primary-key table of the same at-least-once feed: two
    pipelines, each with its own log, checkpoint and table."""
    append_rows = spark.read.option("basePath", (p := _stream(
        spark, sf_dir, "append-reconcile", "append", lambda t: t, kind="redelivered",
        sink_factory=M.append_by_day_sink))).parquet(p)
    path = _upsert_table(spark, sf_dir, "pk-reconcile")
    pk = K.read_merged(spark, path, K.merge_latest("event_id", ("batch_id", "offset")))
    return reconcile(append_rows, pk).select(
        F.col("append_rows").cast("long"), F.col("pk_rows").cast("long"),
        "distinct_ids", "missing_in_pk", "missing_in_append",
        F.col("duplicate_rows").cast("long"))


@register("compact_result_log", QB_SQL)
def compact_result_log(spark, sf_dir):
    """Q-B written as an upsert result log (JSON key, JSON value), then
    compacted to the newest value per key and decoded back."""
    def emitter(path):
        return lambda batch, batch_id: emit(path, batch, batch_id)

    def emit(path, batch, batch_id):
        (batch.select(F.to_json(F.struct("region")).alias("key"),
                      F.to_json(F.struct(*batch.columns)).alias("value"),
                      F.lit(0).alias("partition"),
                      F.lit(batch_id).cast("long").alias("offset"),
                      F.current_timestamp().alias("emitted_at"))
         .write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}"))

    path = _stream(spark, sf_dir, "result-log", "update", M.qb_running_total,
                   sink_factory=emitter, state_partitions=REGION_STATE_PARTITIONS)
    log = spark.read.parquet(path)
    newest = log.groupBy("key").agg(
        F.max_by("value", F.struct("partition", "offset")).alias("value"))
    v = F.from_json("value", "region STRING, event_count BIGINT, total_amount DECIMAL(22,2), "
                    "max_event_time TIMESTAMP")
    return newest.select(v.alias("v")).select("v.*")


@register("dedup_stream", with_txn(
    "SELECT event_id, user_id, region, event_type, event_time FROM transactions"))
def dedup_stream(spark, sf_dir):
    """Duplicate suppression on event_id with bounded state
    (dropDuplicatesWithinWatermark over the at-least-once feed), after a
    map-side dedupe so a key with many copies does not load one task."""
    from ..operators.dedup import local_dedupe

    def dedupe(typed):
        cols = typed.select("event_id", "user_id", "region", "event_type", "event_time")
        return (local_dedupe(cols, ["event_id"])
                .withWatermark("event_time", "10 minutes")
                .dropDuplicatesWithinWatermark(["event_id"])
                .select("event_id", "user_id", "region", "event_type", "event_time"))
    out = _stream(spark, sf_dir, "dedup", "append", dedupe, kind="redelivered")
    return spark.read.parquet(out).drop("batch_id")


LATE_COPY_S = 9 * 86400


@register("dedup_late", with_txn(
    "SELECT event_id, user_id, amount, region, event_type, event_time FROM transactions"))
def dedup_late(spark, sf_dir):
    """Exact duplicate suppression over a feed whose copies come days behind
    the watermark: every event once, the first arrival's values."""
    from ..streaming.dedup import dedup_sink
    records = EL.redelivered_records(transactions(spark, sf_dir), LATE_COPY_S)
    log, out = fresh_dir(spark, "log-dedup-late"), fresh_dir(spark, "dedup-late")
    runner.replay(EL.segments(records, chunk_count(spark, sf_dir) + 1), log,
                  lambda: M.typed_stream(spark, log, keep_position=True), "dedup-late", "append", dedup_sink(out))
    return spark.read.parquet(f"{out}/rows").select(
        "event_id", "user_id", "amount", "region", "event_type", "event_time")


@register("reconcile_keys", with_txn("""
SELECT event_id, CAST(1 AS BIGINT) AS left_rows,
       CAST(CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS BIGINT) AS right_rows,
       CASE WHEN event_type = 'signup' THEN 'missing_right' ELSE 'different' END AS status
FROM transactions WHERE (event_type = 'signup' AND user_id % 50 = 0) OR (event_type = 'error' AND user_id % 50 = 1)
"""))
def reconcile_keys(spark, sf_dir):
    """Two pipelines compared by bucket digests, and key by key where those
    differ: the second one loses some events and damages others."""
    from ..operators.digest import reconcile_by_digest
    some = lambda kind, k: (F.col("event_type") == kind) & (F.col("user_id") % 50 == k)
    lossy = lambda t: t.where(~some("signup", 0)).withColumn(
        "amount", F.when(some("error", 1), F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(12,2)"))
    one = spark.read.parquet(_stream(spark, sf_dir, "whole", "append", lambda t: t))
    two = spark.read.parquet(_stream(spark, sf_dir, "lossy", "append", lossy))
    return reconcile_by_digest(one.drop("batch_id"), two.drop("batch_id"), "event_id")


# middle of the events' time span, where a consumer starts
MIDDLE_SQL = """middle AS (SELECT make_timestamp((epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2)
                                     // 1000 * 1000) AS cut FROM events)"""


def _started_midway(spark, sf_dir, start):
    """A consumer started when half of the log is there, stopped, and started
    again on its checkpoint after the rest has been appended in two steps."""
    first, last = EL.time_chunks(table(spark, sf_dir, "events"), 2)
    log, out, ckpt = (fresh_dir(spark, f"{x}-{start}") for x in ("log", "table", "checkpoint"))
    records = lambda e: EL.records_from_transactions(transactions_from_events(e))
    EL.append_chunk(records(first), log, 0)
    later = [last.where(F.col("event_id") % 2 == 0), last.where(F.coalesce(F.col("event_id") % 2 != 0, F.lit(True)))]
    for seq, part in enumerate([None, *later]):
        if part is not None:
            EL.append_chunk(records(part), log, seq)
        q = snapshot.follow(spark, log, f"from-{start}", M.typed_rows, runner.batch_writer(out), ckpt, start)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out)


@register("snapshot_then_follow", with_txn("""
SELECT CASE WHEN event_time < cut THEN 'snapshot' ELSE 'follow' END AS phase, region,
       count(*) AS rows, count(DISTINCT event_id) AS events, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM transactions, middle GROUP BY 1, 2""", MIDDLE_SQL))
def snapshot_then_follow(spark, sf_dir):
    """Start position 'full': the log up to the boundary as one batch job,
    then the stream from there; every event once over the handover."""
    t = _started_midway(spark, sf_dir, "full")
    return (t.groupBy(F.when(F.col("batch_id") == snapshot.SNAPSHOT, "snapshot").otherwise("follow").alias("phase"),
                      "region")
            .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("events"),
                 F.sum("amount").cast("decimal(22,2)").alias("total_amount")))


@register("scan_latest", with_txn("""
SELECT event_id, user_id, amount, region, event_type, event_time FROM transactions, middle
WHERE event_time >= cut""", MIDDLE_SQL))
def scan_latest(spark, sf_dir):
    """Start position 'latest': only what arrives after the consumer started."""
    return _started_midway(spark, sf_dir, "latest").select(
        "event_id", "user_id", "amount", "region", "event_type", "event_time")


@register("late_rows", with_txn("""
SELECT event_id, region, event_time FROM transactions
WHERE event_type = 'signup'
  AND event_time < (SELECT max(event_time) FROM transactions WHERE event_type <> 'signup')
                   - INTERVAL 1 MINUTE"""))
def late_rows(spark, sf_dir):
    """Rows behind the watermark go to a side table instead of vanishing."""
    path = _stream(spark, sf_dir, "late", "append", lambda t: t, kind="late",
                   sink_factory=lambda p: M.late_split_sink(p, 60))
    return spark.read.parquet(f"{path}/late").select("event_id", "region", "event_time")


@register("enrich_stream", with_txn("""
SELECT t.event_id, t.user_id, t.amount, t.region, t.event_type, t.event_time,
       c.c_name, n.n_name, r.r_name
FROM transactions t
LEFT JOIN customer c ON t.user_id = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""))
def enrich_stream(spark, sf_dir):
    """Stream-static left join: events -> customer -> nation -> region."""
    dims = [table(spark, sf_dir, n) for n in ("customer", "nation", "region")]
    out = _stream(spark, sf_dir, "enrich", "append",
                  lambda t: J.enrich(t.drop("ingest_time"), *dims))
    return spark.read.parquet(out).drop("batch_id")


@register("enrich_changing", with_txn("""
SELECT t.event_id, t.user_id, t.amount, t.region, t.event_type, t.event_time,
       CASE WHEN t.event_time >= cut AND c.c_nationkey % 2 = 0 THEN c.c_name || ' (moved)' ELSE c.c_name END AS c_name,
       n.n_name, r.r_name
FROM transactions t CROSS JOIN middle
LEFT JOIN customer c ON t.user_id = c.c_custkey
LEFT JOIN nation n ON n.n_nationkey = CASE WHEN t.event_time >= cut AND c.c_nationkey % 2 = 0
                                           THEN c.c_nationkey + 1 ELSE c.c_nationkey END
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""", MIDDLE_SQL))
def enrich_changing(spark, sf_dir):
    """Enrichment while the customer dimension changes: half-way through the
    feed the customers of every other nation move to the next one."""
    from ..streaming import enrich as E
    log, out, dim = (fresh_dir(spark, x) for x in ("log-changing", "enriched", "customers"))
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    moves = F.col("c_nationkey") % 2 == 0
    moved = (customer.withColumn("c_name", F.when(moves, F.concat("c_name", F.lit(" (moved)")))
                                 .otherwise(F.col("c_name")))
             .withColumn("c_nationkey", F.when(moves, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))))
    sink = E.enrich_sink(out, lambda sp: (E.current(sp, dim), nation, region))
    ckpt = None
    for seq, (part, version) in enumerate(zip(EL.time_chunks(table(spark, sf_dir, "events"), 2), (customer, moved))):
        E.publish(version, dim)
        ckpt = runner.replay([EL.records_from_transactions(transactions_from_events(part))], log,
                             lambda: M.typed_stream(spark, log).drop("ingest_time"), "enrich-changing", "append",
                             sink, checkpoint=ckpt, first_seq=seq)
    return spark.read.parquet(out).drop("batch_id")


# the frame of each region's newest row: RANGE 5 MINUTE PRECEDING, ends included
QC_SQL = with_txn("""
SELECT t.region, count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount,
       max(event_time) AS max_event_time
FROM transactions t JOIN (SELECT region, max(event_time) AS newest
                          FROM transactions GROUP BY region) n ON t.region = n.region
WHERE t.event_time >= n.newest - INTERVAL 5 MINUTE
GROUP BY t.region""")


@register("qc_stateful", QC_SQL)
def qc_stateful(spark, sf_dir):
    """Q-C as keyed state per region (transformWithStateInPandas),
    millisecond buckets, newest row per region from the update changelog."""
    from ..streaming.qc_state import qc_stateful as build
    out = _stream(spark, sf_dir, "qc-state", "update", build,
                  state_partitions=REGION_STATE_PARTITIONS)
    return _latest_changes(spark, out, ["region"])


@register("qc_idle", with_txn("""
SELECT t.region, CAST(count_if(t.event_time >= n.newest - INTERVAL 5 MINUTE AND live) AS BIGINT) AS event_count,
       CAST(sum(CASE WHEN t.event_time >= n.newest - INTERVAL 5 MINUTE AND live THEN amount END)
            AS DECIMAL(22,2)) AS total_amount,
       max(event_time) AS max_event_time
FROM transactions t JOIN (
  SELECT region, max(event_time) AS newest, max(event_time) + INTERVAL 5 MINUTE
         >= (SELECT max(event_time) FROM transactions) - INTERVAL 1 MINUTE AS live
  FROM transactions GROUP BY region) n ON t.region = n.region
GROUP BY t.region"""))
def qc_idle(spark, sf_dir):
    """Q-C with event-time timers: a region whose newest event lies more than
    the frame behind the watermark shows no events, and holds no state."""
    from ..streaming.qc_state import qc_stateful as build
    out = _stream(spark, sf_dir, "qc-idle", "update", lambda t: build(t, "1 minute"),
                  state_partitions=REGION_STATE_PARTITIONS)
    return _latest_changes(spark, out, ["region"])


@register("qc_partials", QC_SQL)
def qc_partials(spark, sf_dir):
    """Q-C the scalable way for hot keys: per-millisecond partials per batch,
    the last 5 minutes of each region re-aggregated on read."""
    path = _partials(spark, sf_dir, "qc-partials", M.partials_qc)
    newest = (spark.read.parquet(path).groupBy(F.col("region").alias("_region"))
              .agg(F.max("ms").alias("_newest")))
    # no frame begins before this instant, so older partials are not read
    low = newest.agg(F.min("_newest")).first()[0]
    recent = K.read_merged(spark, path, lambda d: K.merge_partials(["ms", "region"])(
        d if low is None else d.where(F.col("ms") >= F.lit(low - 300_000))))
    frame = recent.join(newest, F.col("region").eqNullSafe(F.col("_region"))).where(
        F.col("ms") >= F.col("_newest") - F.lit(300_000))
    return (frame.groupBy("region")
            .agg(F.sum("event_count").alias("event_count"),
                 F.sum("total_amount").cast("decimal(22,2)").alias("total_amount"),
                 F.max("max_event_time").alias("max_event_time")))
