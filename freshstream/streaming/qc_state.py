"""Q-C on a stream: last 5 minutes per region, kept incrementally.

Spark refuses OVER windows on streams, so the frame is kept as keyed state, in
pieces: per region, a map from second to the buckets ``millisecond -> (count,
amounts, cents)`` of that second, and one value with the newest time and the
frame's running sums.  A micro-batch reads and writes the seconds it brings rows
for and removes the seconds that leave the frame, adding to and taking from the
sums; the frame as a whole is never read, so the cost follows the new
milliseconds, whatever the frame holds.  Event times have whole milliseconds, so
the frame - the region's newest event time and the 5 minutes before it, both
ends included - is exact.  Each micro-batch emits one row per changed region.  A
NULL region is a key of its own; rows without an event time are in no frame;
NULL amounts are counted as events but not added up.

An idle region keeps its last frame, as an OVER window does.  With ``idle_delay``
set, an event-time timer closes that gap: once the watermark has passed the
newest event by 5 minutes, the region's state is dropped and a row with no events
is emitted.  (The watermark then also drops rows later than ``idle_delay``.)

Skew: only 7 keys, so at most 7 busy stateful tasks.  Rows are therefore
combined per (region, millisecond) *before* the shuffle by a stateless
``mapInPandas`` step, so the stateful operator receives at most one row per
(task, region, millisecond) however hot a region is.  Amounts travel as integer
cents: exact sums without decimal objects in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FRAME_MS = 300_000
BUCKET_SCHEMA = "region STRING, ms LONG, cnt LONG, amounts LONG, cents LONG"
OUTPUT_SCHEMA = "region STRING, event_count LONG, amounts LONG, total_cents LONG, max_ms LONG"
SECOND_SCHEMA = "ms ARRAY<LONG>, cnts ARRAY<LONG>, amounts ARRAY<LONG>, cents ARRAY<LONG>"
SUMS_SCHEMA = "newest LONG, oldest_second LONG, cnt LONG, amounts LONG, cents LONG"


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf) == 0:
            continue
        g = (pdf.groupby(["region", "ms"], sort=False, dropna=False)
             .agg(cnt=("cnt", "sum"), amounts=("amounts", "sum"), cents=("cents", "sum"))
             .reset_index())
        g["region"] = g["region"].astype(object).where(g["region"].notna(), None)
        yield g[["region", "ms", "cnt", "amounts", "cents"]]


class LastFiveMinutes(StatefulProcessor):
    """``seconds``: second -> its buckets as parallel arrays, at most 301 entries;
    ``sums``: newest ms, oldest second, and the frame's sums."""

    def __init__(self, timers: bool = False):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds = handle.getMapState("seconds", "second LONG", SECOND_SCHEMA)
        self.sums = handle.getValueState("sums", SUMS_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if len(new) == 0:
            return
        held = self.sums.get() if self.sums.exists() else None
        newest, oldest, total = held[0] if held else None, held[1] if held else None, list(held[2:]) if held else [0] * 3
        before = newest
        top = int(new["ms"].max())
        newest = top if newest is None else max(newest, top)
        low = newest - FRAME_MS
        # rows of this batch that are in the frame, second by second
        new = new[new["ms"] >= low].groupby("ms", sort=True)[["cnt", "amounts", "cents"]].sum()
        touched = {}
        for ms, c, a, x in zip(new.index.tolist(), *[new[n].tolist() for n in ("cnt", "amounts", "cents")]):
            touched.setdefault(ms // 1000, {})[ms] = (c, a, x)
        # seconds that leave the frame, wholly or (the last of them) in part
        if oldest is not None:
            for second in range(oldest, min(low // 1000, before // 1000) + 1):
                if self.seconds.containsKey((second,)):
                    total = self._cut(second, low, total)
        for second, values in touched.items():
            buckets = self._read(second)
            for ms, v in values.items():
                old = buckets.get(ms, (0, 0, 0))
                buckets[ms] = tuple(o + int(n) for o, n in zip(old, v))
                total = [t + int(n) for t, n in zip(total, v)]
            self._write(second, buckets)
        first = min(touched, default=newest // 1000)
        oldest = max(low // 1000, first if oldest is None else min(oldest, first))
        self.sums.update((newest, oldest, *total))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(newest + FRAME_MS + 1)
        yield self._row(key, *total, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self.sums.get()[0]
        self.seconds.clear()
        self.sums.clear()
        yield self._row(key, 0, 0, 0, newest)

    def close(self) -> None:
        pass

    def _read(self, second: int) -> dict[int, tuple]:
        if not self.seconds.containsKey((second,)):
            return {}
        ms, *columns = self.seconds.getValue((second,))
        return dict(zip(ms, zip(*columns)))

    def _write(self, second: int, buckets: dict[int, tuple]) -> None:
        ms = sorted(buckets)
        self.seconds.updateValue((second,), (ms, *[[buckets[m][i] for m in ms] for i in range(3)]))

    def _cut(self, second: int, low: int, total: list[int]) -> list[int]:
        """Take what is before ``low`` out of a second and out of the sums."""
        buckets = self._read(second)
        gone = [ms for ms in buckets if ms < low]
        for ms in gone:
            total = [t - v for t, v in zip(total, buckets.pop(ms))]
        if not buckets:
            self.seconds.removeKey((second,))
        elif gone:
            self._write(second, buckets)
        return total

    @staticmethod
    def _row(key, count, amounts, cents, newest) -> pd.DataFrame:
        return pd.DataFrame({"region": [key[0]], "event_count": [count], "amounts": [amounts],
                             "total_cents": [cents], "max_ms": [newest]})


def qc_stateful(typed: DataFrame, idle_delay: str | None = None) -> DataFrame:
    """Typed stream -> per-batch (region, event_count, total_amount, max_event_time)."""
    buckets = typed.where(F.col("event_time").isNotNull()).select(
        "region", F.unix_millis(F.col("event_time")).alias("ms"), F.lit(1).cast("long").alias("cnt"),
        F.col("amount").isNotNull().cast("long").alias("amounts"),
        F.coalesce((F.col("amount") * F.lit(100)).cast("long"), F.lit(0)).alias("cents"))
    combined = buckets.mapInPandas(_combine, BUCKET_SCHEMA)
    if idle_delay is not None:
        combined = combined.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", idle_delay)
    out = combined.groupBy("region").transformWithStateInPandas(
        LastFiveMinutes(idle_delay is not None), OUTPUT_SCHEMA, "Update",
        "None" if idle_delay is None else "EventTime")
    total = (F.col("total_cents").cast("decimal(22,0)") / F.lit(100)).cast("decimal(22,2)")
    return out.select("region", "event_count", F.when(F.col("amounts") > 0, total).alias("total_amount"),
                      F.timestamp_millis("max_ms").alias("max_event_time"))
