"""Distributed prefix / suffix scans over time-ordered rows.

A running aggregate over the whole time axis (newest event seen so far,
messages appended so far) would be a window with no partition key - every
row in one task.  Here it is two-level:

  1. within each (series, day) group: the running aggregate (a window
     partitioned by series and day);
  2. per (series, day): the group total; a window over those day rows (one
     row per series and day) carries the total of all *earlier* days;
  3. join the carry back on (series, day) and combine.

Only step 2 orders rows across the whole span, and it holds one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {"max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: a + b),
            "min": (F.min, F.least)}


def running_many(df: DataFrame, keys: list[str], time_col: str,
                 specs: list[tuple[str, Column, str]], inclusive_peers: bool = True) -> DataFrame:
    """Add one column per ``(out, value, fn)`` spec: fn(value) over all rows of
    the same ``keys`` with time <= this row's time (peers included) -
    computed in day groups.  All specs share one pass: one window within
    (keys, day), one day total, one carry window, one join."""
    day = F.date_trunc("day", F.col(time_col))
    d = df.withColumn("_day", day)
    for i, (_, value, _fn) in enumerate(specs):
        d = d.withColumn(f"_v{i}", value)
    frame = Window.partitionBy(*keys, "_day").orderBy(time_col)
    frame = (frame.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive_peers
             else frame.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = d.select("*", *[_COMBINE[fn][0](f"_v{i}").over(frame).alias(f"_in{i}")
                            for i, (_, _v, fn) in enumerate(specs)])
    days = d.groupBy(*keys, "_day").agg(*[_COMBINE[fn][0](f"_v{i}").alias(f"_tot{i}")
                                          for i, (_, _v, fn) in enumerate(specs)])
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = days.select(*keys, "_day", *[_COMBINE[fn][0](f"_tot{i}").over(before)
                                         .alias(f"_carry{i}")
                                         for i, (_, _v, fn) in enumerate(specs)])
    j = inner.join(carry, [*keys, "_day"], "left")
    tmp = ["_day"]
    for i, (out, _v, fn) in enumerate(specs):
        comb = _COMBINE[fn][1]
        j = j.withColumn(out, F.when(F.col(f"_carry{i}").isNull(), F.col(f"_in{i}"))
                         .otherwise(comb(F.col(f"_in{i}"), F.col(f"_carry{i}"))))
        tmp += [f"_v{i}", f"_in{i}", f"_carry{i}"]
    return j.drop(*tmp)


def running(df: DataFrame, keys: list[str], time_col: str, value: Column, out: str,
            fn: str = "max", inclusive_peers: bool = True) -> DataFrame:
    """Add ``out`` = fn(value) over all rows of the same ``keys`` with
    time <= this row's time (peers included) - computed in day groups."""
    return running_many(df, keys, time_col, [(out, value, fn)], inclusive_peers)


def suffix_min_from(points: DataFrame, point_col: str, data: DataFrame, time_col: str,
                    value_col: str, out: str) -> DataFrame:
    """For each row of ``points``: min(value) over ``data`` rows with
    time >= point.  Points and data are merged per day; the within-day
    suffix comes from a window partitioned by day, later days from one row
    per day."""
    pts = points.select("*", F.col(point_col).alias("_t"), F.lit(None).cast(
        data.schema[value_col].dataType).alias("_v"), F.lit(True).alias("_is_pt"))
    dat = data.select(F.col(time_col).alias("_t"), F.col(value_col).alias("_v"),
                      F.lit(False).alias("_is_pt"))
    both = pts.unionByName(dat, allowMissingColumns=True).withColumn(
        "_day", F.date_trunc("day", F.col("_t")))
    w = (Window.partitionBy("_day").orderBy("_t")
         .rangeBetween(Window.currentRow, Window.unboundedFollowing))
    within = both.withColumn("_in", F.min("_v").over(w)).where(F.col("_is_pt"))
    # every day that has data or points (point-only days carry later days too)
    days = both.groupBy("_day").agg(F.min("_v").alias("_tot"))
    after = Window.orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    carry = days.select("_day", F.min("_tot").over(after).alias("_carry"))
    j = within.join(carry, "_day", "left")
    res = F.least(F.col("_in"), F.col("_carry"))  # least() skips NULLs
    return j.withColumn(out, res).drop("_t", "_v", "_is_pt", "_day", "_in", "_carry")
