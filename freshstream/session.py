"""SparkSession construction and the shared work folder.

Everything the library writes (stream checkpoints, replay logs, hot/cold
tables, compacted outputs) lives under one root: the folder the cluster
names in ``spark.checkpoint.dir``.  On a cluster that is a shared,
fault-tolerant file system.  Only a ``local[...]`` session without it (tests)
gets one under the system temp folder, recorded in the session; on a cluster
a missing setting is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every query in the library assumes.  They only pin semantics
# (UTC clocks, ANSI arithmetic) and enable runtime re-planning; sizes such
# as shuffle partitions are left to the caller / cluster defaults.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hot keys: AQE splits partitions above this size in joins.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Large state (Q-B / Q-C / dedupe) goes to RocksDB, not the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "freshstream", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the library's settings.

    ``master`` / ``shuffle_partitions`` are for local runs; on a cluster
    leave them ``None`` and let the deployment decide.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {**SEMANTIC_CONF, **SCALE_CONF, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def ensure_semantics(spark: SparkSession) -> None:
    """Pin UTC for a session we did not build (e.g. the driver's)."""
    for k, v in SEMANTIC_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def work_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``; set one only when the session has
    none (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="freshstream-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # pragma: no cover - e.g. Spark Connect
        pass
    return root.rstrip("/")


def materialize(df):
    """Cut lineage: write ``df`` once under ``spark.checkpoint.dir`` (a
    reliable checkpoint on the shared file system, so a lost executor does
    not lose it) and continue from the written files.  Used for small
    intermediate tables that a plan reads more than once, so their (large)
    input is scanned once."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unique (not yet existing) path under the work root; never
    reused across runs, so no run ever overwrites another's output."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on the cluster file system (no data read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
