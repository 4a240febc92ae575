"""The event log: JSON messages in a topic-like record envelope.

``key STRING, value STRING, partition INT, offset BIGINT, timestamp TIMESTAMP``

Live, the log is a Kafka topic (``readStream.format("kafka")``, needs the
Kafka connector jar).  Offline, and in every test, the same envelope is
derived from the supplied ``events`` table and replayed from files, so the
downstream code is identical either way.

Replay rules (deterministic, so oracles can rebuild them):
  * key       = user_id as text (keeps per-user order, as the producer does)
  * partition = user_id mod 12
  * offset    = event_id (unique and increasing with event time, so it is a
                valid, gap-tolerant, per-partition arrival order; no global
                ranking window is needed to assign it)
  * timestamp = the row's ingest_time (broker append time)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.time import format_event_time
from ..schema import RECORD_SCHEMA, TOPIC_PARTITIONS


def message_json(event_id: Column, user_id: Column, amount: Column, region: Column,
                 event_type: Column, event_time_text: Column) -> Column:
    return F.to_json(F.struct(event_id.alias("event_id"), user_id.alias("user_id"),
                              amount.alias("amount"), region.alias("region"),
                              event_type.alias("event_type"),
                              event_time_text.alias("event_time")))


def records_from_transactions(txn: DataFrame, dirty: bool = False,
                              offset: Column | None = None) -> DataFrame:
    """Render typed rows as log records.

    ``dirty=True`` turns every ``error``-typed event into a damaged message,
    the kind picked by ``user_id mod 5``:
      0 plain text, not JSON      1 amount as text "n/a"
      2 amount missing            3 event_time junk
      4 event_time without 'Z' (still valid)"""
    et_text = format_event_time(F.col("event_time"))
    clean = message_json(F.col("event_id"), F.col("user_id"), F.col("amount"),
                         F.col("region"), F.col("event_type"), et_text)
    value = clean
    if dirty:
        kind = F.pmod(F.col("user_id"), F.lit(5))
        value = (
            F.when(F.col("event_type") != "error", clean)
            .when(kind == 0, F.concat(F.lit("event "), F.col("event_id"), F.lit(" amount "),
                                      F.col("amount").cast("string")))
            .when(kind == 1, message_json(F.col("event_id"), F.col("user_id"), F.lit("n/a"),
                                          F.col("region"), F.col("event_type"), et_text))
            .when(kind == 2, F.to_json(F.struct(
                "event_id", "user_id", "region", "event_type", et_text.alias("event_time"))))
            .when(kind == 3, message_json(F.col("event_id"), F.col("user_id"), F.col("amount"),
                                          F.col("region"), F.col("event_type"),
                                          F.lit("not-a-time")))
            .otherwise(message_json(F.col("event_id"), F.col("user_id"), F.col("amount"),
                                    F.col("region"), F.col("event_type"),
                                    F.date_format(F.col("event_time"),
                                                  "yyyy-MM-dd'T'HH:mm:ss.SSS")))
        )
    return txn.select(
        F.col("user_id").cast("string").alias("key"),
        value.alias("value"),
        F.pmod(F.col("user_id"), F.lit(TOPIC_PARTITIONS)).cast("int").alias("partition"),
        (offset if offset is not None else F.col("event_id").cast("long")).alias("offset"),
        F.col("ingest_time").alias("timestamp"),
    )


def csv_records(txn: DataFrame, sep: str = ",", null_value: str = "\\N", null_kind: str = "error") -> DataFrame:
    """Typed rows as CSV-valued records; rows of type ``null_kind`` come with
    a null amount, so the null text is exercised."""
    amount = F.when(F.col("event_type") != null_kind, F.col("amount"))
    line = F.to_csv(F.struct("event_id", "user_id", amount.alias("amount"), "region", "event_type",
                             format_event_time(F.col("event_time")).alias("event_time")),
                    {"sep": sep, "nullValue": null_value})
    return txn.select(
        F.col("user_id").cast("string").alias("key"), line.alias("value"),
        F.pmod(F.col("user_id"), F.lit(TOPIC_PARTITIONS)).cast("int").alias("partition"),
        F.col("event_id").cast("long").alias("offset"), F.col("ingest_time").alias("timestamp"))


def redelivered_records(txn: DataFrame, after_s: int = 1) -> DataFrame:
    """An at-least-once feed: every ``purchase`` is sent twice.

    The second copy arrives ``after_s`` seconds later (one: right after the
    original in the same partition; offsets ``2*event_id`` and ``2*event_id + 1``), and
    carries a corrected amount (+1.00) - the same key with a different value,
    so last-write-wins is observable."""
    copies = F.explode(F.when(F.col("event_type") == "purchase", F.array(F.lit(0), F.lit(1)))
                       .otherwise(F.array(F.lit(0))))
    t = (txn.withColumn("_copy", copies)
         .withColumn("amount", (F.col("amount") + F.col("_copy")).cast("decimal(12,2)"))
         .withColumn("ingest_time",
                     F.timestamp_add("SECOND", F.col("_copy") * after_s, F.col("ingest_time"))))
    return records_from_transactions(
        t, offset=F.col("event_id").cast("long") * 2 + F.col("_copy"))


def chunk_bounds(records: DataFrame, chunks: int) -> list:
    """Append-time boundaries splitting the log into ``chunks`` parts of
    about equal size (one sampled quantile pass)."""
    if chunks <= 1:
        return []
    return (records.select(F.unix_micros(F.col("timestamp")).alias("t"))
            .approxQuantile("t", [i / chunks for i in range(1, chunks)], 0.001))


def segments(records: DataFrame, chunks: int) -> list[DataFrame]:
    """The log as ``chunks`` append-time ranges, oldest first (lazy frames;
    each is a range filter over the same source)."""
    ts_long = F.unix_micros(F.col("timestamp"))
    bounds = [None, *chunk_bounds(records, chunks), None]
    out = []
    for i in range(len(bounds) - 1):
        part = records
        lo, hi = bounds[i], bounds[i + 1]
        if lo is not None:
            part = part.where(ts_long > F.lit(int(lo)))
        if hi is not None:
            part = part.where(ts_long <= F.lit(int(hi)))
        out.append(part)
    return out


def event_chunks(events: DataFrame, chunks: int) -> list[DataFrame]:
    """``events`` as ``chunks`` ranges of the raw ``ts`` column, oldest first
    (rows without one in the first).  The bounds come from one pass over that
    column; each chunk is a pushed-down filter, so writing all of them reads
    a time-ordered table about once.  The rows of a chunk are evened out: in such
    a table they lie in one or two splits, whose tasks would write all of it."""
    at = (events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
          .approxQuantile("t", [i / chunks for i in range(1, chunks)], 0.001)) if chunks > 1 else []
    # whole milliseconds: the typed event time falls on the same side
    cuts = sorted({int(t) // 1000 * 1000 for t in at})
    bounds = [F.timestamp_micros(F.lit(c)).cast(events.schema["ts"].dataType) for c in cuts]
    ts, out = F.col("ts"), []
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = events
        if lo is not None:
            part = part.where(ts >= lo)
        if hi is not None:
            part = part.where((ts < hi) | ts.isNull() if lo is None else ts < hi)
        out.append(part.hint("rebalance"))
    return out


def time_chunks(events: DataFrame, chunks: int) -> list[DataFrame]:
    """``events`` as ``chunks`` equal spans of the raw ``ts`` column, oldest
    first (rows without one in the first): bounds are exact (``lo + (hi - lo) * k
    div chunks``, down to the millisecond), one pass over that column."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(micros), F.max(micros)).first()
    cuts = [] if lo is None else [(lo + (hi - lo) * k // chunks) // 1000 * 1000 for k in range(1, chunks)]
    return between(events, cuts, chunks)


def between(events: DataFrame, cuts: list[int], chunks: int) -> list[DataFrame]:
    """The ``chunks`` ranges of ``ts`` between cuts (microseconds)."""
    kind = events.schema["ts"].dataType
    edges = [F.timestamp_micros(F.lit(c)).cast(kind) for c in cuts]
    out, ts = [], F.col("ts")
    for k in range(chunks):
        part = events
        if k and cuts:
            part = part.where(ts >= edges[k - 1])
        if k < len(edges):
            part = part.where((ts < edges[k]) | ts.isNull() if k == 0 else ts < edges[k])
        out.append(part.hint("rebalance") if cuts or k == 0 else part.limit(0))
    return out


def append_chunk(part: DataFrame, path: str, seq: int, fmt: str = "json",
                 rows_per_file: int | None = None) -> str:
    """Append one chunk to the log folder, written in parallel by all tasks
    (files sorted by append time within each task).  ``rows_per_file`` bounds a
    file, so that a consumer's row limit can be counted in files."""
    out = f"{path}/chunk={seq:06d}"
    w = part.sortWithinPartitions("timestamp", "offset").write.mode("errorifexists").format(fmt)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.save(out)
    return out


def write_log(records: DataFrame, path: str, chunks: int = 4, fmt: str = "json") -> list[str]:
    """Write the whole log at once (for batch reads; streams use the
    producer-style ``streaming.runner.replay``)."""
    return [append_chunk(p, path, i, fmt) for i, p in enumerate(segments(records, chunks))]


def read_log(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Batch read of a replay log directory."""
    return (spark.read.format(fmt).schema(RECORD_SCHEMA)
            .option("recursiveFileLookup", "true").load(path))


def log_end(spark: SparkSession, path: str) -> int:
    """Number of the newest complete chunk in the log's listing (-1: none)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/chunk=*")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(p) or []
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=-1)


def start_boundary(spark: SparkSession, path: str, checkpoint: str) -> int:
    """Where this consumer started: the log's end at its first start, kept in
    its checkpoint, so a restart does not move it."""
    from ..session import path_exists
    kept = f"{checkpoint}/start"
    if not path_exists(spark, f"{kept}/_SUCCESS"):
        (spark.range(1).select(F.lit(log_end(spark, path)).cast("long").alias("boundary"))
         .write.mode("overwrite").parquet(kept))
    return spark.read.parquet(kept).first()["boundary"]


def stream_log(spark: SparkSession, path: str, fmt: str = "json",
               files_per_trigger: int | None = None, start: str = "earliest",
               start_timestamp=None, preset: str | None = None, rows_per_file: int | None = None,
               after_chunk: int | None = None) -> DataFrame:
    """Streaming read of a replay log directory.

    ``preset`` bounds a micro-batch (``streaming.presets``; ``rows_per_file`` as
    the log was written), ``files_per_trigger`` does so directly.  ``start``:
    ``earliest`` replays everything, ``timestamp`` keeps records at or after
    ``start_timestamp``, ``latest`` reads chunks after ``after_chunk`` only - the
    ``start_boundary`` of the consumer (partition-pruned: older chunks are
    listed, not read)."""
    from ..streaming.presets import PRESETS
    options = PRESETS[preset].file_options(rows_per_file) if preset else {}
    if files_per_trigger:
        options = {"maxFilesPerTrigger": files_per_trigger}
    r = spark.readStream.format(fmt).options(**options)
    if start == "latest":
        if after_chunk is None:
            raise ValueError("latest needs the consumer's start boundary (after_chunk)")
        chunked = StructType(RECORD_SCHEMA.fields[:]).add("chunk", "integer")
        return (r.schema(chunked).option("basePath", path).load(path)
                .where(F.col("chunk") > after_chunk).drop("chunk"))
    df = r.schema(RECORD_SCHEMA).option("recursiveFileLookup", "true").load(path)
    if start == "timestamp" and start_timestamp is not None:
        df = df.where(F.col("timestamp") >= F.lit(start_timestamp).cast("timestamp"))
    return df


def read_chunks(spark: SparkSession, path: str, upto: int, fmt: str = "json") -> DataFrame:
    """Batch read of the chunks up to and including ``upto``."""
    if upto < 0:
        return spark.createDataFrame([], RECORD_SCHEMA)
    chunked = StructType(RECORD_SCHEMA.fields[:]).add("chunk", "integer")
    return (spark.read.format(fmt).schema(chunked).option("basePath", path).load(path)
            .where(F.col("chunk") <= upto).drop("chunk"))


def kafka_stream(spark: SparkSession, servers: str, topic: str, start: str = "earliest",
                 preset: str | None = None, **options) -> DataFrame:
    """Live source.  Needs the Kafka connector on the classpath; the output
    has the same envelope as the replay log.  ``start`` may be ``earliest`` or
    ``latest``; ``preset`` sets the limits of a micro-batch."""
    from ..streaming.presets import PRESETS
    options = {**(PRESETS[preset].kafka_options() if preset else {}), **options}
    r = (spark.readStream.format("kafka")
         .option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic)
         .option("startingOffsets", start))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "partition", "offset", "timestamp")


def from_timestamp(records: DataFrame, start) -> DataFrame:
    """Start position 'timestamp': records appended at or after ``start``."""
    return records.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
