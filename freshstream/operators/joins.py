"""Enrichment joins: events -> customer -> nation -> region.

Broadcast only behind a size check: ``bounded_broadcast`` measures the
dimension - rows and bytes, in one aggregate over exactly the columns that
will be shipped - and hints broadcast only when both are within bounds;
otherwise the join is left to the planner (sort-merge with AQE skew
splitting, or AQE's own runtime broadcast when the measured size is small).
nation / region are fixed-size TPC-H dimensions (25 / 5 rows) but still go
through the same check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 * 1024 * 1024
# bytes of one row beyond its values (null bits, offsets, hash-table entry)
ROW_OVERHEAD_BYTES = 16


def _value_bytes(f: T.StructField) -> Column:
    """Bytes a value of this column takes in a row (variable-length types
    measured, fixed-width ones by their width)."""
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + F.lit(8)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.col(f.name))), F.lit(0)) + F.lit(8)
    wide = isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18
    return F.lit(16 if wide else 8)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df`` - one distributed aggregate, two numbers back."""
    size = F.lit(ROW_OVERHEAD_BYTES)
    for f in df.schema.fields:
        size = size + _value_bytes(f)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def fits_broadcast(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    rows, size = measure(dim)
    return rows <= max_rows and size <= max_bytes


def bounded_broadcast(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(dim)`` when its measured rows and bytes are within bounds,
    else ``dim`` unchanged (the planner picks a shuffle join)."""
    return F.broadcast(dim) if fits_broadcast(dim, max_rows, max_bytes) else dim


def geography(customer: DataFrame, nation: DataFrame, region: DataFrame,
              max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """customer -> (c_custkey, c_name, n_name, r_name), left joins."""
    n = bounded_broadcast(nation.select("n_nationkey", "n_name", "n_regionkey"), max_rows)
    r = bounded_broadcast(region.select("r_regionkey", "r_name"), max_rows)
    return (customer.select("c_custkey", "c_name", "c_nationkey")
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select("c_custkey", "c_name", "n_name", "r_name"))


def hot_keys(df: DataFrame, key: str, fraction: float = 0.01, sample: float = 0.01,
             max_keys: int = 1000, seed: int = 7) -> list:
    """Keys holding at least ``fraction`` of ``df``'s rows, estimated from a
    sample (a routing decision only: results do not depend on it).  At most
    ``max_keys`` are returned, so the list is bounded."""
    s = df.select(key).sample(fraction=sample, seed=seed)
    counts = s.groupBy(key).count()
    total = s.count()
    if total == 0:
        return []
    rows = (counts.where(F.col("count") >= F.lit(max(1.0, fraction * total)))
            .orderBy(F.desc("count")).limit(max_keys).collect())
    return [r[key] for r in rows]


def skew_split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                    how: str = "left", keys: list | None = None,
                    max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Equi-join that survives a hot key on the left.

    Rows of hot keys join a broadcast of only the matching right rows (their
    count is checked); all other rows take the ordinary shuffle join.  Each
    key is routed to exactly one side, so inner / left results are exact."""
    hot = keys if keys is not None else hot_keys(left, left_key)
    if not hot:
        return left.join(right, left[left_key] == right[right_key], how)
    is_hot_l = F.col(left_key).isin(hot)
    r_hot = bounded_broadcast(right.where(F.col(right_key).isin(hot)), max_rows)
    hot_part = left.where(is_hot_l).join(r_hot, F.col(left_key) == F.col(right_key), how)
    cold_l = left.where(~is_hot_l | F.col(left_key).isNull())
    cold_part = cold_l.join(right.where(~F.col(right_key).isin(hot)),
                            F.col(left_key) == F.col(right_key), how)
    return hot_part.unionByName(cold_part)


def enrich(txn: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame,
           max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Per-event enrichment (stream-static or batch): left join on user_id.

    The geography is broadcast when within ``max_rows``.  Beyond it, a batch
    input takes the skew-split join (hot users through a broadcast of their
    own rows); a stream keeps the stream-static shuffle join - apply
    ``skew_split_join`` per micro-batch in ``foreachBatch`` if users are hot."""
    geo = geography(customer, nation, region, max_rows)
    if fits_broadcast(geo, max_rows):
        return (txn.join(F.broadcast(geo), txn["user_id"] == geo["c_custkey"], "left")
                .drop("c_custkey"))
    if not txn.isStreaming:
        return skew_split_join(txn, geo, "user_id", "c_custkey", "left").drop("c_custkey")
    return txn.join(geo, txn["user_id"] == geo["c_custkey"], "left").drop("c_custkey")


def totals_by_nation(txn: DataFrame, customer: DataFrame, nation: DataFrame,
                     region: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Q1 by geography.  Events are first reduced to one row per user
    (partial aggregate, so a hot user is combined map-side); only that
    per-user table meets the customer dimension."""
    per_user = (txn.groupBy("user_id")
                .agg(F.count(F.lit(1)).alias("c"), F.sum("amount").alias("s")))
    geo = geography(customer, nation, region, max_rows)
    j = per_user.join(bounded_broadcast(geo, max_rows),
                      per_user["user_id"] == geo["c_custkey"], "left")
    return (j.groupBy("r_name", "n_name")
            .agg(F.sum("c").alias("cnt"), F.sum("s").cast("decimal(22,2)").alias("total")))
