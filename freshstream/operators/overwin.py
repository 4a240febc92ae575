"""Q-C: the last 5 minutes per region.

``over_range`` - one output row per event: COUNT / SUM / MAX over
``RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW`` (peers with
equal time included), partitioned by region.

A sliding frame recomputes its aggregate for every row, so its cost is rows
times frame.  Here a frame is the difference of two running totals instead:
all rows up to ``t`` minus all rows before ``t - 5 min``; running totals grow by one
row at a time, so the cost is linear however dense a frame is.

``over_pairs``: the time axis is cut into stretches as long as the frame.  A frame
lies in its own stretch and the one before, so every event goes to its stretch
twice - as itself, and as a marker at ``t - 5 min`` - and once, as context, to the
next one.  One scan, one shuffle on (region, stretch), one running total; event
and marker meet again in the same partition.

``over_slices``: where so many events fall into one stretch of a region that it is
too much for a task (``most_rows``), running totals are taken in slices of one
second, and a slice's total gets a carry of all slices before it, scanned in two
levels; neither a hot region nor a dense 5 minutes is one task's work.  It costs
several shuffles.  ``over_range`` counts and takes the one that fits; both give
the same rows.

``hopping`` - the built-in alternative: 5-minute windows sliding every 10 s.
Rows are first combined per (region, 10 s slice) - a map-side partial
aggregate - and only those slice rows are fanned out to the 30 windows
they belong to, so the 30x expansion is applied to slices, not events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SLICES_PER_STRETCH = 3600


#: Events of one region within one frame length that one task may take.
MOST_ROWS = 5_000_000


def over_range(txn: DataFrame, window_seconds: int = 300, partition_col: str = "region",
               time_col: str = "event_time", keep: tuple[str, ...] = ("event_id",),
               slice_micros: int | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """Exact RANGE frame per event from running totals.

    NULL regions are one partition; rows with NULL time are each other's frame
    (as in SQL, where NULLs are peers); a frame without any amount has a NULL
    total.  ``slice_micros`` asks for ``over_slices``."""
    if slice_micros is None:
        stretch = F.floor(F.unix_micros(F.col(time_col)) / F.lit(window_seconds * MICROS_PER_SECOND))
        fullest = (txn.groupBy(partition_col, stretch.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
                   .agg(F.max("n").alias("n")).first()["n"])
        if (fullest or 0) <= most_rows:
            return over_pairs(txn, window_seconds, partition_col, time_col, keep)
        slice_micros = MICROS_PER_SECOND
    return over_slices(txn, window_seconds, partition_col, time_col, keep, slice_micros)


def over_pairs(txn: DataFrame, window_seconds: int = 300, partition_col: str = "region",
               time_col: str = "event_time", keep: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Frames from pairs of neighbouring stretches; see ``over_range``."""
    width = window_seconds * MICROS_PER_SECOND
    rows = txn.select(
        F.monotonically_increasing_id().alias("_u"), F.struct(*keep, partition_col, time_col).alias("_row"),
        F.unix_micros(F.col(time_col)).alias("_t"), F.col(partition_col).alias("_p"),
        F.col("event_id").isNotNull().cast("long").alias("_c"), F.col("amount").cast("decimal(22,2)").alias("_a"))
    b = F.floor(F.col("_t") / F.lit(width))
    ask = lambda b, q, phase, own: F.struct(b.alias("b"), q.alias("q"), F.lit(phase).alias("phase"),
                                            F.lit(own).alias("own"))
    # at equal times markers (phase 0) come before events; rows without a time are peers
    itself, context = ask(b, F.col("_t"), 1, True), ask(b + 1, F.col("_t"), 1, False)
    marker = ask(b, F.col("_t") - F.lit(width), 0, True)
    asks = F.when(F.col("_t").isNull(), F.array(itself)).otherwise(F.array(itself, marker, context))
    counts = F.col("_ask.phase") == 1
    e = rows.withColumn("_ask", F.explode(asks)).select(
        "_p", "_u", F.col("_ask.b").alias("_s"), F.col("_ask.q").alias("_q"), F.col("_ask.phase").alias("_phase"),
        F.col("_ask.own").alias("_own"), F.when(F.col("_ask.own"), F.col("_row")).alias("_row"),
        F.when(counts, F.col("_c")).alias("_c"), F.when(counts, F.col("_a")).alias("_a"))
    run = (Window.partitionBy("_p", "_s").orderBy("_q", "_phase")
           .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    zero = F.lit(0).cast("decimal(22,2)")
    e = e.select("_p", "_s", "_u", "_row", "_own", "_phase", F.coalesce(F.sum("_c").over(run), F.lit(0)).alias("c"),
                 F.coalesce(F.sum("_a").over(run).cast("decimal(22,2)"), zero).alias("a"),
                 F.count("_a").over(run).alias("n")).where("_own")
    sign = F.when(F.col("_phase") == 1, F.lit(1)).otherwise(F.lit(-1))
    # an event and its marker are in one partition already: no shuffle
    out = e.groupBy("_p", "_s", "_u", "_row").agg(*[F.sum(F.col(x) * sign).alias(x) for x in ("c", "a", "n")])
    return out.select("_row.*", F.col("c").cast("long").alias("event_count"),
                      F.when(F.col("n") > 0, F.col("a").cast("decimal(22,2)")).alias("total_amount"),
                      F.col(f"_row.{time_col}").alias("max_event_time"))


def over_slices(txn: DataFrame, window_seconds: int = 300, partition_col: str = "region",
                time_col: str = "event_time", keep: tuple[str, ...] = ("event_id",),
                slice_micros: int = MICROS_PER_SECOND) -> DataFrame:
    """Frames from totals of narrow slices; see ``over_range``."""
    payload = F.struct(*keep, partition_col, time_col)
    t = F.unix_micros(F.col(time_col))
    rows = txn.select(F.monotonically_increasing_id().alias("_u"), payload.alias("_row"),
                      F.coalesce(F.concat(F.lit("="), F.col(partition_col).cast("string")),
                                 F.lit("NULL")).alias("_p"),
                      t.alias("_t"), F.col("event_id").isNotNull().cast("long").alias("_c"),
                      F.col("amount").cast("decimal(22,2)").alias("_a"))
    timed = rows.where(F.col("_t").isNotNull())
    # the event itself (counts, sign +) and its marker (does not count, sign -)
    asks = F.explode(F.array(
        F.struct(F.col("_t").alias("q"), F.lit(1).alias("role")),
        F.struct((F.col("_t") - F.lit(window_seconds * MICROS_PER_SECOND)).alias("q"),
                 F.lit(0).alias("role"))))
    e = timed.withColumn("_ask", asks).select(
        "_u", "_p", F.col("_ask.q").alias("_q"), F.col("_ask.role").alias("_role"),
        F.floor(F.col("_ask.q") / F.lit(slice_micros)).cast("long").alias("_s"),
        *[F.when(F.col("_ask.role") == 1, F.col(c)).alias(c) for c in ("_row", "_c", "_a")])
    # totals of all slices before a slice
    totals = [F.sum("_c").alias("c"), F.sum("_a").alias("a"), F.count("_a").alias("n")]
    slices = e.groupBy("_p", "_s").agg(*totals).withColumn(
        "_h", F.floor(F.col("_s") / F.lit(SLICES_PER_STRETCH)))
    before = (Window.unboundedPreceding, -1)
    names = ("c", "a", "n")
    stretches = slices.groupBy("_p", "_h").agg(*[F.sum(x).alias(x) for x in names])
    over_h = Window.partitionBy("_p").orderBy("_h").rowsBetween(*before)
    over_s = Window.partitionBy("_p", "_h").orderBy("_s").rowsBetween(*before)
    zero = F.lit(0).cast("decimal(22,2)")
    stretches = stretches.select("_p", "_h", *[F.coalesce(F.sum(x).over(over_h), zero).alias(f"h{x}")
                                               for x in names])
    carry = (slices.select("_p", "_s", "_h", *[F.coalesce(F.sum(x).over(over_s), zero).alias(f"s{x}")
                                               for x in names])
             .join(stretches, ["_p", "_h"])
             .select("_p", "_s", *[(F.col(f"s{x}") + F.col(f"h{x}")).alias(x) for x in names]))
    # inside a slice; at equal times markers come before events
    own = (Window.partitionBy("_p", "_s").orderBy("_q", "_role")
           .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    run = {"c": F.sum("_c").over(own), "a": F.sum("_a").over(own), "n": F.count("_a").over(own)}
    e = e.select("_u", "_p", "_s", "_role", "_row", *[F.coalesce(v, zero).alias(f"r{k}") for k, v in run.items()])
    e = e.join(carry, ["_p", "_s"])
    sign = F.when(F.col("_role") == 1, F.lit(1)).otherwise(F.lit(-1))
    out = e.groupBy("_u").agg(F.max("_row").alias("_row"),
                              *[F.sum((F.col(f"r{x}") + F.col(x)) * sign).alias(x) for x in names])
    framed = out.select("_row.*", F.col("c").cast("long").alias("event_count"),
                        F.when(F.col("n") > 0, F.col("a").cast("decimal(22,2)")).alias("total_amount"))
    framed = framed.withColumn("max_event_time", F.col(time_col))
    untimed = rows.where(F.col("_t").isNull())
    peers = untimed.groupBy("_p").agg(F.sum("_c").alias("event_count"),
                                      F.sum("_a").cast("decimal(22,2)").alias("total_amount"))
    untimed = untimed.join(peers, "_p").select("_row.*", "event_count", "total_amount")
    return framed.unionByName(untimed.withColumn("max_event_time", F.col(time_col)))


def hopping(txn: DataFrame, size_seconds: int = 300, slide_seconds: int = 10,
            partition_col: str = "region", time_col: str = "event_time") -> DataFrame:
    if size_seconds % slide_seconds:
        raise ValueError("window size must be a multiple of the slide")
    n = size_seconds // slide_seconds
    s_us = slide_seconds * MICROS_PER_SECOND
    slice_start = F.timestamp_micros(
        F.floor(F.unix_micros(F.col(time_col)) / F.lit(s_us)).cast("long") * F.lit(s_us))
    slices = (txn.groupBy(partition_col, slice_start.alias("_slice"))
              .agg(F.count(F.lit(1)).alias("c"), F.sum("amount").alias("s"),
                   F.max(time_col).alias("m")))
    fan = slices.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.timestamp_micros(F.unix_micros(F.col("_slice")) - F.col("_k") * F.lit(s_us))
    return (fan.groupBy(start.alias("window_start"), partition_col)
            .agg(F.sum("c").alias("event_count"),
                 F.sum("s").cast("decimal(22,2)").alias("total_amount"),
                 F.max("m").alias("max_event_time"))
            .withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {size_seconds} SECONDS")))
