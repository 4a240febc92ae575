"""Per-batch enrichment: dimension updates are seen, hot users span tasks."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from freshstream.schema import table, transactions
from freshstream.streaming import enrich as E


def dims(spark):
    return [table(spark, SF_SMALL, n) for n in ("customer", "nation", "region")]


def test_update_between_batches_is_seen_and_unfinished_versions_are_not(spark, workdir):
    customer, nation, region = dims(spark)
    path = f"{workdir}/customer"
    assert E.publish(customer, path) == 0
    sink = E.enrich_sink(f"{workdir}/out", lambda sp: (E.current(sp, path), nation, region))
    txn = transactions(spark, SF_SMALL).drop("ingest_time")
    sink(txn, 0)
    assert E.publish(customer.withColumn("c_name", F.lit("new")), path) == 1
    customer.limit(1).write.parquet(f"{workdir}/half")
    import os
    os.makedirs(f"{path}/version=2")                     # being written: no _SUCCESS yet
    sink(txn, 1)
    names = {r.batch_id: r.n for r in spark.read.parquet(f"{workdir}/out").where("c_name IS NOT NULL")
             .groupBy("batch_id").agg(F.countDistinct("c_name").alias("n")).collect()}
    assert names[0] > 1 and names[1] == 1
    sink(txn, 0)                                          # a replay rewrites its folder
    assert spark.read.parquet(f"{workdir}/out").count() == 2 * txn.count()


def test_hot_user_beyond_the_bound_spans_tasks(spark, workdir):
    """Two thirds of a batch belong to one user and the dimension is above
    the bound: only that user's own dimension row is broadcast, so the rows
    stay where they are; results equal the plain join."""
    customer, nation, region = dims(spark)
    txn = transactions(spark, SF_SMALL).drop("ingest_time").crossJoin(spark.range(20)).drop("id").repartition(6)
    hot = txn.withColumn("user_id", F.when(F.col("event_id").cast("long") % 3 > 0, 7).otherwise(F.col("user_id")))
    sink = E.enrich_sink(f"{workdir}/out", lambda sp: (customer, nation, region), max_rows=40)
    sink(hot, 0)
    out = spark.read.parquet(f"{workdir}/out/batch_id=0")
    files = (out.where("user_id = 7").select(F.input_file_name().alias("f"), F.lit(1).alias("n"))
             .groupBy("f").count().collect())
    assert len(files) > 1
    c, n, r = dims(spark)
    want = (hot.join(c, F.col("user_id") == F.col("c_custkey"), "left")
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(*out.columns))
    assert out.exceptAll(want).count() == 0 and out.count() == hot.count()
