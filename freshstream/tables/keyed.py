"""Batch-keyed tables: idempotent per-batch deltas, merge on read, compaction.

Layout under ``path``::

    batch_id=<n>/...        rows written by micro-batch n (overwrite = idempotent)
    _base/upto=<k>/...      compacted result of all batches <= k
    _commits/upto=<k>/...   one-row marker, written *after* the base it names

Readers take the newest committed ``upto`` once, then read that base plus
the deltas with ``batch_id > upto`` (partition pruning).  A compaction fixes
its own ``upto`` once - the newest batch that, like all before it, is completely
written (``_SUCCESS``) - and reads nothing newer, so a batch that lands
meanwhile stays a delta.  A compaction that
dies before its marker is invisible; one that finishes changes nothing in
the answer.  Old deltas and bases are left for a retention job, so no file
is deleted while a reader may hold it.

This serves two table kinds of the reference:
  * partial-aggregate tables (merge = sum / sum / max per key),
  * primary-key tables (merge = latest per key by arrival),
Writes cost only the new rows; the merge is one shuffle on the table key
with a map-side partial step, so a hot key never lands whole in one task.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from ..session import path_exists
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except Exception as e:  # empty / missing folder
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def committed_upto(spark: SparkSession, path: str) -> int | None:
    marks = _read_or_none(spark, f"{path}/_commits")
    if marks is None:
        return None
    row = marks.agg(F.max("upto").alias("m")).first()
    return row["m"]


def finished_upto(spark: SparkSession, path: str) -> int | None:
    """The newest batch such that it and all earlier ones are complete."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id=*")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {int(s.getPath().getName().split("=")[1]): fs.exists(
        jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")) for s in fs.globStatus(p) or []}
    done = None
    for n in sorted(found):
        if not found[n]:
            break
        done = n
    return done


def deltas(spark: SparkSession, path: str, after: int | None = None,
           up_to: int | None = None) -> DataFrame | None:
    d = _read_or_none(spark, path)
    if d is not None and up_to is not None:
        d = d.where(F.col("batch_id") <= F.lit(up_to))
    if d is not None and after is not None:
        d = d.where(F.col("batch_id") > F.lit(after))
    return d


def expire_folded(spark: SparkSession, path: str, keep_bases: int = 2) -> int:
    """Retention: delete deltas that the oldest of the last ``keep_bases``
    committed bases already holds, and the bases before it; returns the
    number of folders deleted.  Readers of a kept base miss nothing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    number = lambda s: int(s.getPath().getName().split("=")[1])
    marks = sorted(map(number, fs.globStatus(p(f"{path}/_commits/upto=*")) or []))
    if len(marks) < keep_bases:
        return 0
    oldest = marks[-keep_bases]
    gone = [s.getPath() for s in fs.globStatus(p(f"{path}/batch_id=*")) or [] if number(s) <= oldest]
    for kind in ("_commits", "_base"):       # a marker goes before its base
        gone += [s.getPath() for s in fs.globStatus(p(f"{path}/{kind}/upto=*")) or [] if number(s) < oldest]
    for g in gone:
        fs.delete(g, True)
    return len(gone)


def read_merged(spark: SparkSession, path: str, merge: Merge, up_to: int | None = None) -> DataFrame:
    """Base (if committed) + newer deltas (to ``up_to``, if given), merged.
    The commit is read once."""
    upto = committed_upto(spark, path)
    d = deltas(spark, path, upto, up_to)
    parts = []
    if upto is not None:
        parts.append(spark.read.parquet(f"{path}/_base/upto={upto}")
                     .withColumn("batch_id", F.lit(upto).cast("int")))
    if d is not None:
        parts.append(d)
    if not parts:
        raise FileNotFoundError(f"no data under {path}")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return merge(df)


def read_latest(spark: SparkSession, path: str, key: str,
                order: tuple[str, ...] = ("batch_id", "offset"), up_to: int | None = None) -> DataFrame:
    """Primary-key read without shuffling the table.

    The compacted base holds one row per key, and every delta is newer than
    it, so the answer is: the newest delta row per key (a shuffle of the
    deltas only - small, bounded by the compaction interval) plus the base
    rows whose key has no delta (an anti join against the delta keys,
    broadcast when their measured size is within bounds; otherwise a
    shuffle join).  Same rows as ``read_merged`` with ``merge_latest``."""
    from ..operators.dedup import latest_per_key
    from ..operators.joins import bounded_broadcast
    upto = committed_upto(spark, path)
    d = deltas(spark, path, upto, up_to)
    if upto is None:
        if d is None:
            raise FileNotFoundError(f"no data under {path}")
        return latest_per_key(d, key, list(order))
    base = (spark.read.parquet(f"{path}/_base/upto={upto}")
            .withColumn("batch_id", F.lit(upto).cast("int")))
    if d is None:
        return base
    newest = latest_per_key(d, key, list(order))
    changed = bounded_broadcast(newest.select(key))
    rest = base.join(changed, key, "left_anti")
    return rest.unionByName(newest, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, merge: Merge,
            layout: Callable[[DataFrame], DataFrame] | None = None,
            reader: Callable[..., DataFrame] | None = None,
            live: Callable[[DataFrame], DataFrame] | None = None) -> int | None:
    """Fold every delta up to the newest complete batch into a new base, then
    commit.  Returns that batch, or None if there was nothing to fold.

    ``reader`` (spark, path, up_to) - or (spark, path), where nothing writes
    meanwhile - replaces the generic merge read - e.g. ``read_latest`` for a
    primary-key table, so the old base is not shuffled by the merge (only by
    ``layout``, once).  ``live`` keeps the rows that have not expired, so the
    base does not grow past the retention."""
    upto = finished_upto(spark, path)
    if upto is None or upto == committed_upto(spark, path):
        return None
    if reader is None:
        current = read_merged(spark, path, merge, upto)
    elif len(inspect.signature(reader).parameters) > 2:
        current = reader(spark, path, upto)
    else:
        current = reader(spark, path)
    merged = current.drop("batch_id")
    if live is not None:
        merged = live(merged)
    if layout is not None:
        merged = layout(merged)
    merged.write.mode("overwrite").parquet(f"{path}/_base/upto={upto}")
    (spark.range(1).select(F.lit(upto).alias("committed"))
     .write.mode("overwrite").parquet(f"{path}/_commits/upto={upto}"))
    return upto


# -- merges -----------------------------------------------------------------

def merge_partials(keys: list[str], count_cols=("event_count",), sum_cols=("total_amount",),
                   max_cols=("max_event_time",)) -> Merge:
    def m(df: DataFrame) -> DataFrame:
        aggs = ([F.sum(c).alias(c) for c in count_cols]
                + [F.sum(c).cast("decimal(22,2)").alias(c) for c in sum_cols]
                + [F.max(c).alias(c) for c in max_cols])
        return df.groupBy(*keys).agg(*aggs)
    return m


def merge_latest(key: str, order=("batch_id", "offset")) -> Merge:
    from ..operators.dedup import latest_per_key

    def m(df: DataFrame) -> DataFrame:
        return latest_per_key(df, key, list(order))
    return m


def hash_bucket_layout(key: str, buckets: int) -> Callable[[DataFrame], DataFrame]:
    """Hash-distributed layout: ``bucket = pmod(xxhash64(key), n)`` (op 21).

    One shuffle, range-partitioned on (bucket, key) over the session's
    partition count - not ``n`` tasks, which would put 1/n of the table in
    each - so every output file holds a contiguous, sorted (bucket, key)
    range: rows of a key are co-located and a bucket is a set of files."""
    def lay(df: DataFrame) -> DataFrame:
        b = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))
        return (df.withColumn("bucket", b).repartitionByRange("bucket", key)
                .sortWithinPartitions("bucket", key))
    return lay
