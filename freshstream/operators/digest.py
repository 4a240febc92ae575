"""Reconciliation of two tables by digest.

Each side is reduced to one row per key bucket - rows, and a sum of row hashes
that does not depend on their order (repeated rows count).  Buckets that agree are
done; only the rows of differing buckets are compared key by key.  Equal tables
cost one aggregate on each side, a few lost rows one more read of their buckets.
At most ``buckets`` rows reach the driver.

A row hash is 64 bits of all compared columns, taken as identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def row_hash(columns: list[str]) -> Column:
    """One hash of all columns; a NULL differs from every value (xxhash64
    alone would skip it)."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def digest(df: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows, checksum: a partial aggregate per task, ``buckets`` rows."""
    return df.groupBy(bucket_of(key, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_hash(columns).cast("decimal(38,0)")).alias("checksum"))


def differing(a: DataFrame, b: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets in which the sides do not agree."""
    both = digest(a, key, columns, buckets).withColumn("sign", F.lit(1)).unionByName(
        digest(b, key, columns, buckets).withColumn("sign", F.lit(-1)))
    left = both.groupBy("bucket").agg(F.sum(F.col("rows") * F.col("sign")).alias("rows"),
                                      F.sum(F.col("checksum") * F.col("sign")).alias("checksum"))
    return sorted(r["bucket"] for r in left.where("rows <> 0 OR checksum <> 0").collect())


def reconcile_by_digest(a: DataFrame, b: DataFrame, key: str, columns: list[str] | None = None,
                        buckets: int = BUCKETS) -> DataFrame:
    """Keys on which the tables differ: key, left_rows, right_rows, status
    (``missing_left``, ``missing_right``, or ``different``).  NULL keys are one key."""
    columns = columns or [c for c in a.columns if c in b.columns]
    wrong = differing(a, b, key, columns, buckets)
    side = lambda df, left: df.where(bucket_of(key, buckets).isin(wrong)).select(
        F.col(key), F.lit(int(left)).alias("l"), F.lit(int(not left)).alias("r"),
        (row_hash(columns).cast("decimal(38,0)") * (1 if left else -1)).alias("h"))
    # partial aggregate per task: a key with many rows is combined before the shuffle
    keys = side(a, True).unionByName(side(b, False)).groupBy(key).agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum("h").alias("h"))
    status = (F.when(F.col("left_rows") == 0, "missing_left").when(F.col("right_rows") == 0, "missing_right")
              .when((F.col("h") != 0) | (F.col("left_rows") != F.col("right_rows")), "different"))
    return keys.withColumn("status", status).where("status IS NOT NULL").select(
        key, "left_rows", "right_rows", "status")
