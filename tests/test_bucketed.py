"""The bucketed primary-key table: touched buckets only, no exchange on its
key, crash and retention behaviour, reads equal to a model."""

import os

from pyspark.sql import functions as F

from freshstream.tables import keyed as K
from freshstream.tables.bucketed import BucketedTable


def rows(spark, lo, hi, amount, offset=0):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("event_id"),
                                      F.lit(amount).alias("amount"), (F.col("id") + offset).alias("offset"))


def table(spark, path, buckets=8):
    return BucketedTable(spark, path, "event_id", rows(spark, 0, 1, 1).schema, buckets)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def content(t):
    return {r.event_id: r.amount for r in t.read().collect()}


def test_untouched_buckets_keep_their_files(spark, workdir):
    t = table(spark, workdir)
    rows(spark, 0, 400, 1).write.parquet(f"{workdir}/batch_id=0")
    assert set(t.compact()) == set(range(8))
    before = t.files()
    rows(spark, 5, 7, 2, 1000).write.parquet(f"{workdir}/batch_id=1")
    touched = t.compact()
    after = t.files()
    assert 1 <= len(touched) <= 2
    assert all(before[b] == after[b] for b in before if b not in touched)
    assert all(not set(before[b]) & set(after[b]) for b in touched)
    assert all(os.path.exists(f.removeprefix("file:").replace("//", "/")) for fs in before.values() for f in fs)
    want = {str(i): 2 if i in (5, 6) else 1 for i in range(400)}
    assert content(t) == want
    assert t.compact() == {}


def test_join_and_aggregate_on_the_key_need_no_exchange(spark, workdir):
    a, b = table(spark, f"{workdir}/a"), table(spark, f"{workdir}/b")
    rows(spark, 0, 300, 1).write.parquet(f"{workdir}/a/batch_id=0")
    rows(spark, 100, 400, 2).write.parquet(f"{workdir}/b/batch_id=0")
    a.compact(), b.compact()
    left, right = a.read(), b.read().withColumnRenamed("amount", "other")
    j = left.join(right.hint("merge"), "event_id")
    assert "Exchange" not in plan(j) and "Bucketed: true" in plan(j) and j.count() == 200
    g = left.groupBy("event_id").count()
    assert "Exchange" not in plan(g) and g.count() == 300


def test_compaction_moves_deltas_only(spark, workdir):
    """The base side of a compaction's merge is a bucketed scan of the touched
    partitions, without an exchange."""
    t = table(spark, workdir)
    rows(spark, 0, 400, 1).write.parquet(f"{workdir}/batch_id=0")
    t.compact()
    some = t.base(t.versions(), [3])
    text = plan(some)
    assert "PartitionFilters" in text and "bucket#" in text and some.count() < 100
    newest = rows(spark, 0, 5, 2).repartition(8, "event_id")
    merged = t.base(t.versions()).join(newest.select("event_id").hint("merge"), "event_id", "left_anti")
    scan = plan(merged).split("SortMergeJoin")[1].split("FileScan")[0]
    assert "Exchange" not in scan


def test_unfinished_compaction_is_invisible_and_rerun_replaces_it(spark, workdir):
    t = table(spark, workdir)
    rows(spark, 0, 50, 1).write.parquet(f"{workdir}/batch_id=0")
    t.compact()
    rows(spark, 0, 50, 2, 100).write.parquet(f"{workdir}/batch_id=1")
    # a run that wrote its partitions but died before the marker
    rows(spark, 0, 50, 9).withColumn("upto", F.lit(1)).withColumn("bucket", t.bucket_of(F.col("event_id"))) \
        .createOrReplaceTempView("half")
    spark.sql(f"INSERT INTO {t.register()} PARTITION (upto, bucket) SELECT * FROM half")
    assert K.committed_upto(spark, workdir) == 0
    assert content(t) == {str(i): 2 for i in range(50)}          # base 0 and the delta
    assert set(t.compact().values()) == {1}
    assert content(t) == {str(i): 2 for i in range(50)}
    assert t.base(t.versions()).count() == 50


def test_newest_by_arrival_late_nulls_and_repeats(spark, workdir):
    t = table(spark, workdir, buckets=3)
    nullable = "event_id string, amount int, offset bigint"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 2), ("a", 4, 3), (None, 7, 6)],
                          nullable).write.parquet(f"{workdir}/batch_id=0")
    t.compact()
    spark.createDataFrame([("b", 8, 0), ("c", None, 1), ("c", None, 1)], nullable) \
        .write.parquet(f"{workdir}/batch_id=1")
    assert content(t) == {"a": 2, "b": 8, "c": None, None: 7}
    t.compact()
    assert content(t) == {"a": 2, "b": 8, "c": None, None: 7}


def test_empty_table(spark, workdir):
    t = table(spark, workdir)
    assert t.read().count() == 0 and t.compact() == {} and t.files() == {}


def test_recovered_in_a_new_session(spark, workdir):
    t = table(spark, workdir)
    rows(spark, 0, 60, 1).write.parquet(f"{workdir}/batch_id=0")
    t.compact()
    spark.sql(f"DROP TABLE {t.name}")
    again = table(spark, workdir)
    assert len(content(again)) == 60
    by_key = plan(again.read().groupBy("event_id").count())
    assert "Bucketed: true" in by_key and "Exchange" not in by_key


def test_old_versions_go_and_answers_stay(spark, workdir):
    """Folders stay bounded over many compactions."""
    t = table(spark, workdir, buckets=2)
    for i in range(8):
        rows(spark, i, i + 3, i, 100 * i).write.parquet(f"{workdir}/batch_id={i}")
        t.compact()
        t.drop_old_versions(keep=2)
        want = {str(k): min(k, i) for k in range(i + 3)}
        assert content(t) == want
        assert len(t._partitions()) <= 4
        assert len([f for f in os.listdir(workdir) if f.startswith("batch_id")]) <= 2
        assert len(os.listdir(f"{workdir}/_commits")) <= 2 or i < 2
