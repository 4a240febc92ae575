"""Registered tiering / read-mode queries (ops 9, 10, 17-19, 22)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import regional as R
from ..operators.clock import MAX_DELAY, clock
from ..schema import table, transactions, transactions_from_events
from ..session import fresh_dir
from ..sources import event_log as EL
from ..streaming import maintained as M
from ..streaming import runner
from ..tables import tiering as TR
from .registry import AS_OF_SQL, register, state_of, with_txn

TYPED = ["event_id", "user_id", "amount", "region", "event_type", "event_time", "ingest_time"]
_TIERED: dict = {}

# Tiering point of the replay: midnight of the last ingest day, minus 7 days.
CUTOFF_SQL = "(SELECT date_trunc('day', max(ingest_time)) - INTERVAL 7 DAY FROM transactions)"


def _cutoff(spark, sf_dir):
    c = clock(spark, sf_dir)
    return c.replace(hour=0, minute=0, second=0, microsecond=0) - dt.timedelta(days=7)


def tiered_root(spark, sf_dir):
    """Replay events into the hot tier, tier everything before the cutoff,
    then replay the rest (same checkpoint: the stream resumes)."""
    # the build is shared by the queries of one session over unchanged files
    state = state_of(spark, sf_dir)
    if state in _TIERED:
        return _TIERED[state]
    root = fresh_dir(spark, "tiered")
    log = fresh_dir(spark, "log-tiered")
    cutoff = _cutoff(spark, sf_dir)
    cut = F.lit(cutoff).cast("timestamp")
    # a row is ingested within MAX_DELAY after its event: both sides prune on ts
    events, day = table(spark, sf_dir, "events"), F.lit(cutoff).cast("timestamp_ntz")
    first = EL.event_chunks(events.where((F.col("ts") < day) | F.col("ts").isNull()), 4)
    rest = EL.event_chunks(events.where(F.col("ts") >= day - MAX_DELAY), 4)
    chunks = lambda parts, keep: [EL.records_from_transactions(transactions_from_events(e).where(keep))
                                  for e in parts]

    def build():
        return M.typed_stream(spark, log, keep_position=True)

    before = chunks(first, F.coalesce(F.col("ingest_time") < cut, F.lit(True)))
    after = chunks(rest, F.col("ingest_time") >= cut)
    ckpt = runner.replay(before, log, build, "tiered", "append", TR.hot_sink(root))
    TR.tier(spark, root, now=cutoff)
    runner.replay(after, log, build, "tiered", "append", TR.hot_sink(root), checkpoint=ckpt,
                  first_seq=len(before))
    _TIERED[state] = (root, cutoff)
    return root, cutoff


def _cold(spark, sf_dir):
    root, _ = tiered_root(spark, sf_dir)
    name = "cold_" + root.rsplit("-", 1)[-1]
    TR.register_external(spark, name, root)
    return TR.read_cold(spark, root, table_name=name).select(*TYPED)


def _union(spark, sf_dir):
    root, _ = tiered_root(spark, sf_dir)
    return TR.read_union(spark, root, primary_key="event_id").select(*TYPED)


COLD_CTE = f"cold AS (SELECT * FROM transactions WHERE ingest_time < {CUTOFF_SQL})"


@register("tier_epochs", with_txn(f"""
SELECT 0 AS epoch, CAST(3 AS BIGINT) AS last_batch_id, max(event_time) AS max_event_time,
       count(*) AS row_count, {CUTOFF_SQL} AS committed_at
FROM cold""", COLD_CTE))
def tier_epochs(spark, sf_dir):
    """The epoch log after one tiering run (hot batches 0-3 -> cold epoch 0)."""
    root, _ = tiered_root(spark, sf_dir)
    return TR.tier_epochs(spark, root).select(
        "epoch", "last_batch_id", "max_event_time", "row_count", "committed_at")


_Q1 = """SELECT region, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(22,2)) AS total,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS avg_amount FROM {t} GROUP BY region"""
_Q2 = """SELECT date_trunc('minute', event_time) AS window_start, region,
       count(*) AS event_count, CAST(sum(amount) AS DECIMAL(22,2)) AS total_amount
FROM {t} GROUP BY 1, 2 ORDER BY window_start DESC, total_amount DESC, region LIMIT 120"""
_Q3 = """SELECT max(event_time) AS newest_event_time, {clock} AS query_time,
       date_diff('millisecond', max(event_time), {clock}) AS freshness_lag_ms,
       date_sub('second', max(event_time), {clock}) AS freshness_lag_seconds,
       max(ingest_time) AS newest_ingest_time,
       date_diff('millisecond', max(event_time), max(ingest_time)) AS pipeline_lag_ms,
       count(*) AS total_rows FROM {t}"""


@register("q1_cold", with_txn(_Q1.format(t="cold"), COLD_CTE))
def q1_cold(spark, sf_dir):
    """Q1's aggregate over the committed cold snapshot, read by table name."""
    return R.regional_aggregate(_cold(spark, sf_dir))


@register("q2_cold", with_txn(_Q2.format(t="cold"), COLD_CTE))
def q2_cold(spark, sf_dir):
    return R.q2_tumbling(_cold(spark, sf_dir))


@register("q3_cold", with_txn(_Q3.format(t="cold", clock=AS_OF_SQL), COLD_CTE))
def q3_cold(spark, sf_dir):
    """Freshness of the cold snapshot against the live clock (large lag)."""
    return R.q3_freshness(_cold(spark, sf_dir), clock(spark, sf_dir))


@register("union_read", with_txn(f"SELECT {', '.join(TYPED)} FROM transactions"))
def union_read(spark, sf_dir):
    """Cold snapshot U newer hot rows = the whole table."""
    return _union(spark, sf_dir)


@register("q1_union", with_txn(_Q1.format(t="transactions")))
def q1_union(spark, sf_dir):
    return R.regional_aggregate(_union(spark, sf_dir))


@register("q2_union", with_txn(_Q2.format(t="transactions")))
def q2_union(spark, sf_dir):
    return R.q2_tumbling(_union(spark, sf_dir))


@register("q3_union", with_txn(_Q3.format(t="transactions", clock=AS_OF_SQL)))
def q3_union(spark, sf_dir):
    u = _union(spark, sf_dir)
    return R.q3_freshness(u, clock(spark, sf_dir))


@register("ttl_live_rows", with_txn(f"""
SELECT strftime(event_time, '%Y%m%d%H') AS event_hour, count(*) AS rows,
       max(event_time) AS max_event_time
FROM transactions
WHERE date_trunc('hour', event_time) >= date_trunc('hour', {AS_OF_SQL} - INTERVAL 2 HOUR)
GROUP BY 1"""))
def ttl_live_rows(spark, sf_dir):
    """Retention: an hour-partitioned table keeps only hours newer than
    as_of - 2 h; the expiry job drops whole partitions, readers filter too."""
    from ..tables import retention
    as_of = clock(spark, sf_dir)
    path = fresh_dir(spark, "ttl")
    retention.write_hourly(transactions(spark, sf_dir), path)
    retention.expire(spark, path, as_of, hours=2)
    live = retention.read_live(spark, path, as_of, hours=2)
    return (live.groupBy("event_hour")
            .agg(F.count(F.lit(1)).alias("rows"), F.max("event_time").alias("max_event_time")))


@register("q1_live", with_txn(_Q1.format(t="transactions")))
def q1_live(spark, sf_dir):
    """Q1's aggregate over the live (hot) table: every committed hot batch."""
    root, _ = tiered_root(spark, sf_dir)
    return R.regional_aggregate(TR.read_hot(spark, root).select(*TYPED))


@register("q2_live", with_txn(_Q2.format(t="transactions")))
def q2_live(spark, sf_dir):
    root, _ = tiered_root(spark, sf_dir)
    return R.q2_tumbling(TR.read_hot(spark, root).select(*TYPED))


@register("q3_live", with_txn(_Q3.format(t="transactions", clock=AS_OF_SQL)))
def q3_live(spark, sf_dir):
    root, _ = tiered_root(spark, sf_dir)
    return R.q3_freshness(TR.read_hot(spark, root).select(*TYPED), clock(spark, sf_dir))


# the primary-key table of the at-least-once feed: a purchase's second copy
# (amount + 1, a second later) replaces the first
PK_CTE = """pk AS (
  SELECT event_id, user_id,
         CAST(CASE WHEN event_type = 'purchase' THEN amount + 1 ELSE amount END AS DECIMAL(12,2)) AS amount,
         region, event_type, event_time,
         CASE WHEN event_type = 'purchase' THEN ingest_time + INTERVAL 1 SECOND ELSE ingest_time END
           AS ingest_time
  FROM transactions)"""


def _pk(spark, sf_dir):
    from .streams import primary_key_table
    return primary_key_table(spark, sf_dir).read().select(*TYPED)


@register("q1_pk", with_txn(_Q1.format(t="pk"), PK_CTE))
def q1_pk(spark, sf_dir):
    """Q1 on the primary-key table: buckets plus newer deltas, last write wins."""
    return R.regional_aggregate(_pk(spark, sf_dir))


@register("q2_pk", with_txn(_Q2.format(t="pk"), PK_CTE))
def q2_pk(spark, sf_dir):
    return R.q2_tumbling(_pk(spark, sf_dir))


@register("q3_pk", with_txn(_Q3.format(t="pk", clock=AS_OF_SQL), PK_CTE))
def q3_pk(spark, sf_dir):
    return R.q3_freshness(_pk(spark, sf_dir), clock(spark, sf_dir))
