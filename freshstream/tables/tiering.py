"""Hot / cold tiering with epoch commits, and the three read modes.

Layout under ``root``::

    hot/batch_id=<n>/            rows of micro-batch n (foreachBatch, idempotent)
    hot_commits/batch_id=<n>/    marker written after hot batch n
    cold/epoch=<k>/              sorted Parquet copy of hot batches (prev, last_k]
    tier_epochs/epoch=<k>/       (epoch, last_batch_id, max_event_time, row_count,
                                  committed_at), written after cold/epoch=k

Readers fetch the committed ``(epoch, last_batch_id)`` pair **once** per
query and derive both sides from it, so a commit racing with the read can
neither duplicate nor lose rows:

  * cold only : cold where epoch <= E
  * live      : every committed hot batch
  * union     : cold(epoch <= E)  U  hot(batch_id > last_batch_id(E))

For primary-key tables the union resolves keys present on both sides in
favour of hot; the hot key set is small (one tiering interval) and the
anti join lets AQE broadcast it at run time when its measured size is
small, and fall back to a sort-merge join when it is not.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import latest_per_key


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from ..session import path_exists
    if not path_exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def hot_sink(root: str):
    """foreachBatch writer of the hot table (data, then commit marker)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/hot/batch_id={batch_id}")
        (batch.sparkSession.range(1).select(F.lit(batch_id).alias("committed"))
         .write.mode("overwrite").parquet(f"{root}/hot_commits/batch_id={batch_id}"))
    return write


def committed_epoch(spark: SparkSession, root: str) -> tuple[int | None, int]:
    """(newest epoch, its last tiered batch id) -- read once per query."""
    ep = _read(spark, f"{root}/tier_epochs")
    if ep is None:
        return None, -1
    row = ep.agg(F.max_by(F.struct("epoch", "last_batch_id"), "epoch").alias("e")).first()["e"]
    return row["epoch"], row["last_batch_id"]


def committed_hot_batches(spark: SparkSession, root: str) -> DataFrame | None:
    return _read(spark, f"{root}/hot_commits")


def tier(spark: SparkSession, root: str, sort_cols=("region", "event_time", "event_id"),
         now: dt.datetime | None = None) -> int | None:
    """One tiering epoch: copy newly committed hot batches into cold.

    Idempotent: a rerun after a crash rewrites the same ``cold/epoch=k``
    before the epoch row exists; nothing is visible until that row is."""
    epoch, last = committed_epoch(spark, root)
    commits = committed_hot_batches(spark, root)
    if commits is None:
        return None
    upto = commits.agg(F.max("batch_id").alias("m")).first()["m"]
    if upto is None or upto <= last:  # nothing new (or all of it expired)
        return None
    k = 0 if epoch is None else epoch + 1
    hot = (spark.read.parquet(f"{root}/hot")
           .where((F.col("batch_id") > last) & (F.col("batch_id") <= upto)))
    (hot.drop("batch_id").repartitionByRange(*sort_cols).sortWithinPartitions(*sort_cols)
     .write.mode("overwrite").parquet(f"{root}/cold/epoch={k}"))
    stats = spark.read.parquet(f"{root}/cold/epoch={k}").agg(
        F.max("event_time").alias("max_event_time"), F.count(F.lit(1)).alias("row_count"))
    committed_at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    (stats.select(F.lit(upto).cast("long").alias("last_batch_id"),
                  "max_event_time", "row_count", committed_at.alias("committed_at"))
     .write.mode("overwrite").parquet(f"{root}/tier_epochs/epoch={k}"))
    return k


def tier_epochs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/tier_epochs")


def read_cold(spark: SparkSession, root: str, epoch: int | None = None,
              table_name: str | None = None) -> DataFrame:
    """Committed cold snapshot only.  ``table_name``: read through a catalog
    table (see ``register_external``) instead of the path."""
    if epoch is None:
        epoch, _ = committed_epoch(spark, root)
    if epoch is None:  # nothing tiered yet: an empty snapshot of the hot schema
        return spark.read.parquet(f"{root}/hot").drop("batch_id").limit(0)
    src = spark.table(table_name) if table_name else spark.read.parquet(f"{root}/cold")
    return src.where(F.col("epoch") <= epoch).drop("epoch")


def read_hot(spark: SparkSession, root: str, after_batch: int = -1) -> DataFrame:
    """Committed hot batches newer than ``after_batch`` (data not yet tiered)."""
    hot = spark.read.parquet(f"{root}/hot").where(F.col("batch_id") > after_batch)
    commits = committed_hot_batches(spark, root)
    # Only committed batches: the commit ids are a tiny table (one row per batch).
    return hot.join(commits.select("batch_id"), "batch_id", "left_semi")


def read_union(spark: SparkSession, root: str, primary_key: str | None = None,
               order: tuple[str, ...] = ("batch_id", "offset")) -> DataFrame:
    """Cold snapshot U newer hot rows, from one committed (epoch, batch) pair."""
    epoch, last = committed_epoch(spark, root)
    cold = read_cold(spark, root, epoch)
    hot = read_hot(spark, root, last)
    if primary_key is None:
        return cold.unionByName(hot.drop("batch_id"), allowMissingColumns=True)
    from ..operators.joins import bounded_broadcast
    h = latest_per_key(hot, primary_key, [c for c in order if c in hot.columns])
    # hot = rows since the last tiering epoch: small, so its keys are
    # broadcast (size-checked) and the cold snapshot is not shuffled
    cold_only = cold.join(bounded_broadcast(h.select(primary_key)), primary_key, "left_anti")
    return cold_only.unionByName(h.drop("batch_id"), allowMissingColumns=True)


def expire_hot(spark: SparkSession, root: str, keep_epochs: int = 1) -> int:
    """Delete hot batches (and their markers) that were in the cold tier
    ``keep_epochs`` epochs ago already; returns how many.  A union read that
    began under one of the epochs since then finds all it reads; the hot table
    holds what ``keep_epochs`` + 1 tiering intervals bring, not the whole stream."""
    epochs = _read(spark, f"{root}/tier_epochs")
    if epochs is None:
        return 0
    newest = epochs.agg(F.max("epoch").alias("m")).first()["m"]
    bound = epochs.where(F.col("epoch") == newest - keep_epochs).agg(F.max("last_batch_id").alias("b")).first()["b"]
    if bound is None:
        return 0
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for kind in ("hot_commits", "hot"):               # a marker goes before its batch
        for s in fs.globStatus(p(f"{root}/{kind}/batch_id=*")) or []:
            if int(s.getPath().getName().split("=")[1]) <= bound:
                fs.delete(s.getPath(), True)
                gone += kind == "hot"
    return gone


def register_external(spark: SparkSession, name: str, root: str) -> str:
    """External read-only table over the cold tier (another engine's view of
    the lake): a catalog table by name.  Partitions (epochs) are inferred
    from the folder layout; after each epoch the metadata is refreshed
    (``MSCK REPAIR`` registers new epoch partitions, ``REFRESH`` drops
    cached file listings)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{root}/cold'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.sql(f"REFRESH TABLE {name}")
    return name


def stream_union(spark: SparkSession, root: str, schema) -> DataFrame:
    """The union read as a stream (snapshot, then follow).

    The committed epoch ``E0`` is fixed once at start: the cold side replays
    ``epoch <= E0`` and the hot side follows ``batch_id > last_batch_id(E0)``.
    The two directories are never both read unfiltered: cold is a copy of
    hot, so that would count tiered rows twice.  ``schema``: the typed row
    schema (streaming file sources need it declared)."""
    epoch, last = committed_epoch(spark, root)
    from pyspark.sql.types import StructType
    hot_schema = StructType(schema.fields[:]).add("batch_id", "integer")
    cold_schema = StructType(schema.fields[:]).add("epoch", "integer")
    hot = (spark.readStream.schema(hot_schema)
           .option("basePath", f"{root}/hot").parquet(f"{root}/hot")
           .where(F.col("batch_id") > last).drop("batch_id"))
    if epoch is None:
        return hot
    cold = (spark.readStream.schema(cold_schema)
            .option("basePath", f"{root}/cold").parquet(f"{root}/cold")
            .where(F.col("epoch") <= epoch).drop("epoch"))
    return cold.unionByName(hot)
