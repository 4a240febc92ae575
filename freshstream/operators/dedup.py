"""Latest-per-key (last write wins), duplicate counting and reconciliation.

"Newer replaces older" is by *arrival*, not by event time: the ordering key
is ``(partition, offset)`` of the log record (or ``batch_id`` then offset
across micro-batches).  The latest row is picked with ``max_by`` over a
struct: an aggregate with a partial step, so a key with millions of copies
is combined map-side and never gathered into one task (a ``row_number``
window would sort every copy of the key in a single task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    values = [c for c in df.columns if c not in keys]
    picked = (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")))
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def reconcile(append_rows: DataFrame, pk_rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Row counts of an append table vs a primary-key table of the same feed.

    Both sides are tagged and unioned, then reduced per key in one shuffle
    (partial aggregate: a hot key costs one row per task); a final global
    aggregate gives totals, duplicates (append rows - distinct keys) and the
    keys missing on either side - the anti-join counts without a join."""
    tagged = (append_rows.select(key, F.lit(1).alias("a"), F.lit(0).alias("p"))
              .unionByName(pk_rows.select(key, F.lit(0).alias("a"), F.lit(1).alias("p"))))
    per_key = tagged.groupBy(key).agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    return per_key.agg(
        F.sum("a").alias("append_rows"),
        F.sum("p").alias("pk_rows"),
        F.count_if(F.col("a") > 0).alias("distinct_ids"),
        F.count_if((F.col("a") > 0) & (F.col("p") == 0)).alias("missing_in_pk"),
        F.count_if((F.col("p") > 0) & (F.col("a") == 0)).alias("missing_in_append"),
    ).withColumn("duplicate_rows", F.col("append_rows") - F.col("distinct_ids"))


def local_dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop duplicate keys within each task's Arrow batches, before any
    shuffle (stateless, so it is allowed in front of streaming operators).

    Streaming duplicate suppression has no partial step of its own: without
    this, every copy of a key travels to one task.  After it, at most one
    copy per (task, batch) does."""
    schema = df.schema

    def drop(batches):
        for pdf in batches:
            yield pdf.drop_duplicates(subset=keys, keep="first")

    return df.mapInPandas(drop, schema)
