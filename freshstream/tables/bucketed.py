"""Primary-key table in hash buckets: a catalog table plus newer deltas.

The base is an ordinary Spark table, ``CLUSTERED BY (key) SORTED BY (key) INTO n
BUCKETS`` and partitioned by ``(upto, bucket)``, where ``bucket`` is the number
Spark itself gives a key.  Stream batches land as deltas (``keyed`` layout:
``batch_id=<n>``).  A compaction writes new partitions ``(upto=k, bucket)`` for the
buckets that have deltas, and nothing else: untouched buckets keep their files.
The current partition of a bucket is the newest one not newer than the committed
``upto`` (the commit marker of ``keyed``), so a compaction that dies midway is
invisible, its rerun overwrites its own partitions, and a reader that began
before it keeps its files until ``drop_old_versions``.

Because the base is bucketed on the key, a join or an aggregate on the key of one
or several such tables needs no exchange; a read with open deltas shuffles the
deltas only.  A bucket is one task's work at a compaction, so ``buckets`` has to
grow with the table (about a GB in each); keys are unique, so buckets are even.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dedup import latest_per_key
from ..operators.joins import bounded_broadcast
from . import keyed as K


@contextmanager
def overwriting_partitions(spark: SparkSession):
    """Dynamic partition overwrite for the statements inside."""
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "dynamic")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@dataclass(frozen=True)
class BucketedTable:
    """``path`` holds deltas, markers and the base; ``schema`` the row columns
    (key included, position columns such as ``offset`` too)."""
    spark: SparkSession
    path: str
    key: str
    schema: StructType
    buckets: int = 8
    order: tuple[str, ...] = ("batch_id", "offset")

    @property
    def name(self) -> str:
        """The catalog name, one for each folder."""
        return "pk_" + hashlib.md5(self.path.encode()).hexdigest()[:16]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def bucket_of(self, key: Column) -> Column:
        """The bucket Spark's own bucketing puts ``key`` in."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    # -- the catalog table ----------------------------------------------------

    def register(self) -> str:
        """The base as a catalog table (again in a new session: its partitions
        are recovered from the folders)."""
        if not self.spark.catalog.tableExists(self.name):
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {self.name} ({cols}, upto INT, bucket INT) USING parquet "
                f"PARTITIONED BY (upto, bucket) CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/_buckets'")
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self.name

    def versions(self, committed: int | None = None) -> dict[int, int]:
        """bucket -> upto of its current partition (from the catalog's listing)."""
        committed = K.committed_upto(self.spark, self.path) if committed is None else committed
        current: dict[int, int] = {}
        if committed is None:
            return current
        for upto, bucket in self._partitions():
            if upto <= committed:
                current[bucket] = max(upto, current.get(bucket, upto))
        return current

    def _partitions(self) -> list[tuple[int, int]]:
        rows = self.spark.sql(f"SHOW PARTITIONS {self.register()}").collect()
        found = [dict(part.split("=") for part in r[0].split("/")) for r in rows]
        return [(int(f["upto"]), int(f["bucket"])) for f in found]

    def base(self, versions: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        """Rows of the base: a bucketed scan of the current partitions only
        (a partition filter on the catalog's values)."""
        wanted = F.lit(False)
        by_upto: dict[int, list[int]] = {}
        for bucket, upto in sorted(versions.items()):
            if buckets is None or bucket in buckets:
                by_upto.setdefault(upto, []).append(bucket)
        for upto, some in by_upto.items():
            wanted = wanted | ((F.col("upto") == upto) & F.col("bucket").isin(some))
        return self.spark.table(self.register()).where(wanted).select(*self.columns)

    # -- reading ----------------------------------------------------------------

    def read(self) -> DataFrame:
        """The table's rows: base rows without a delta, and the newest delta of
        each key.  Only the deltas are shuffled."""
        committed = K.committed_upto(self.spark, self.path)
        d = K.deltas(self.spark, self.path, committed) if self._open_batches(committed) else None
        if committed is None:
            if d is None:
                return self.spark.createDataFrame([], self.schema)
            return latest_per_key(d, self.key, list(self.order)).select(*self.columns)
        base = self.base(self.versions(committed))
        if d is None:
            return base
        newest = latest_per_key(d, self.key, list(self.order)).select(*self.columns)
        # the deltas of one compaction interval; a shuffle join beyond the bound
        rest = base.join(bounded_broadcast(newest.select(self.key)), self.key, "left_anti")
        return rest.unionByName(newest)

    def _open_batches(self, committed: int | None) -> bool:
        """Is there a batch newer than the base (a listing, no data)?"""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id=*")
        found = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
        ids = [int(s.getPath().getName().split("=")[1]) for s in found]
        return bool(ids) and (committed is None or max(ids) > committed)

    # -- compaction ---------------------------------------------------------------

    def compact(self) -> dict[int, int]:
        """Fold all complete deltas into new partitions of the touched buckets,
        then commit.  Returns the touched buckets and their new ``upto``."""
        committed, upto = K.committed_upto(self.spark, self.path), K.finished_upto(self.spark, self.path)
        if upto is None or upto == committed:
            return {}
        d = K.deltas(self.spark, self.path, committed, upto)
        touched = sorted(r[0] for r in d.select(self.bucket_of(F.col(self.key))).distinct().collect())
        # hash-partitioned as the base is, so neither side of the join moves again
        newest = (latest_per_key(d, self.key, list(self.order)).select(*self.columns)
                  .repartition(self.buckets, self.key))
        rest = self.base(self.versions(committed) if committed is not None else {}, touched)
        merged = newest if committed is None else rest.join(
            newest.select(F.col(self.key)), self.key, "left_anti").unionByName(newest)
        view = f"{self.name}_new"
        merged.withColumn("bucket", self.bucket_of(F.col(self.key))).createOrReplaceTempView(view)
        cols = ", ".join(f"`{c}`" for c in self.columns)
        # dynamic: replaces the partitions it writes (those of a run that died) and no others
        with overwriting_partitions(self.spark):
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.register()} PARTITION (upto = {upto}, bucket) "
                           f"SELECT {cols}, bucket FROM {view}")
        self.spark.catalog.dropTempView(view)
        (self.spark.range(1).select(F.lit(upto).alias("committed"))
         .write.mode("overwrite").parquet(f"{self.path}/_commits/upto={upto}"))
        return {b: upto for b in touched}

    def drop_old_versions(self, keep: int = 2) -> int:
        """Retention: partitions that none of the last ``keep`` commits reads,
        and the deltas the oldest of those holds; returns how many went."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path
        fs = p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        number = lambda s: int(s.getPath().getName().split("=")[1])
        marks = sorted(map(number, fs.globStatus(p(f"{self.path}/_commits/upto=*")) or []))
        if len(marks) < keep:
            return 0
        kept, oldest = marks[-keep:], marks[-keep]
        used = {(upto, bucket) for c in kept for bucket, upto in self.versions(c).items()}
        gone = [(u, b) for u, b in self._partitions() if (u, b) not in used and u <= kept[-1]]
        for mark in marks[:-keep]:                    # no reader may start from these any more
            fs.delete(p(f"{self.path}/_commits/upto={mark}"), True)
        for upto, bucket in gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (upto = {upto}, bucket = {bucket})")
            fs.delete(p(f"{self.path}/_buckets/upto={upto}/bucket={bucket}"), True)
        old = [s.getPath() for s in fs.globStatus(p(f"{self.path}/batch_id=*")) or [] if number(s) <= oldest]
        for folder in old:
            fs.delete(folder, True)
        return len(gone) + len(old)

    def files(self) -> dict[int, list[str]]:
        """bucket -> the files of its current partition."""
        found: dict[int, list[str]] = {b: [] for b in self.versions()}
        if not found:
            return found
        base = self.spark.table(self.register())
        now = self.versions()
        listed = base.select("upto", "bucket", F.col("_metadata.file_path").alias("f")).distinct().collect()
        for r in listed:
            if now.get(r["bucket"]) == r["upto"]:
                found[r["bucket"]].append(r["f"])
        return {b: sorted(f) for b, f in found.items()}
