"""Recorded measurements: SQL over the recorded tables gives the same figures
as the jobs; what the probes read is what the tables held."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from freshstream.operators import lag as G
from freshstream.plans import lag as P
from freshstream.schema import HISTOGRAM_BOUNDS, table, transactions_from_events
from freshstream.sources import event_log as EL
from freshstream.streaming import measure


@pytest.fixture(scope="module")
def root(spark):
    return P.recorded(spark, SF_SMALL)


def q(root, sql):
    con = duckdb.connect()
    for t in ("ticks", "offsets", "progress"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}/*.parquet')")
    return con.execute(sql).fetchall()


def test_histogram_recomputed_from_recorded_durations(spark, root):
    got = {(r.system, r.query, r.le): r["count"] for r in
           G.probe_histogram(measure.ticks(spark, root)).collect()}
    bounds = [(repr(float(b)), b) for b in HISTOGRAM_BOUNDS] + [("+Inf", float("inf"))]
    for le, b in bounds:
        for system, query, n in q(root, "SELECT system, query, count(*) FILTER (duration_s <= "
                                        f"CAST('{b}' AS DOUBLE)) FROM ticks GROUP BY 1, 2"):
            assert got[system, query, le] == n
    assert len(got) == 9 * len(bounds)
    assert q(root, "SELECT min(duration_s) > 0, count(DISTINCT duration_s) > 5 FROM ticks") == [(True, True)]


def test_lag_recomputed_from_recorded_ticks(spark, root):
    want = q(root, """SELECT system, query, arg_max(l, tick), avg(l), max(l), count(*) FROM (
        SELECT *, date_diff('millisecond', result_max_et, producer_max_et) l FROM ticks) WHERE l IS NOT NULL
        GROUP BY 1, 2 ORDER BY 1, 2""")
    got = [tuple(r) for r in G.system_lag(measure.ticks(spark, root)).orderBy("system", "query").collect()]
    assert got == want and len(got) == 9
    assert any(r[2] > 0 for r in got) and any(r[2] == 0 for r in got)


def test_committed_offsets_are_what_the_batches_observed(spark, root):
    rows = q(root, "SELECT group_id, sum(committed_offset) FROM offsets WHERE tick = 4 GROUP BY 1")
    read = dict(q(root, "SELECT query, CAST(sum(input_rows) AS BIGINT) FROM progress GROUP BY 1"))
    assert {g: int(n) for g, n in rows} == read
    assert len({int(n) for _, n in rows}) == 3            # three cadences, three positions


def test_a_slower_cadence_is_further_behind(spark, workdir):
    chunks = EL.time_chunks(table(spark, SF_SMALL, "events"), 2)
    logs = [EL.records_from_transactions(transactions_from_events(c)) for c in chunks]
    out = measure.record(spark, logs, {"stream": 9, "partials": 1, "append": 2})
    lag = {(r.system, r.query): r for r in G.system_lag(measure.ticks(spark, out)).collect()}
    assert ("stream", "qb") not in lag                    # never consumed, no result, no lag
    assert lag["partials", "qb"].ticks == 2 and lag["partials", "qb"].max_lag_ms == 0
    assert lag["append", "qb"].ticks == 1
    total = G.consumer_lag(measure.offsets(spark, out)).where("partition IS NULL")
    assert {r.group_id: r.lag for r in total.collect()}["stream-qb"] == 1000
    assert measure.ticks(spark, out).agg(F.count("producer_max_et")).first()[0] == 18


def test_queries_that_wait_for_slower_ones_are_not_taken_for_stuck(spark, workdir):
    key = "spark.sql.streaming.noDataProgressEventInterval"
    spark.conf.set(key, "0")                              # every idle trigger leaves a progress, not one in ten seconds
    try:
        chunks = EL.time_chunks(table(spark, SF_SMALL, "events"), 2)
        logs = [EL.records_from_transactions(transactions_from_events(c)) for c in chunks]
        out = measure.record(spark, logs)
    finally:
        spark.conf.unset(key)
    total = G.consumer_lag(measure.offsets(spark, out)).where("partition IS NULL")
    assert {r.group_id: r.lag for r in total.collect()} == {
        "stream-qa": 0, "stream-qb": 0, "stream-qc": 0, "partials": 0, "append": 1000}
    assert measure.last_batch(None) == -1


def test_produce_rate_observes_commits_too(spark):
    """A tick at which only the consumer's commit shows is an observation, at rate 0."""
    import datetime as dt
    at = lambda s: dt.datetime(2024, 1, 1, 12, 0, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    txn = spark.createDataFrame([(12, at(10)), (12, at(45)), (12, at(400))], "user_id long, ingest_time timestamp")
    got = G.produce_rate(G.offset_log(txn)).orderBy("observed_at").collect()
    assert [(r.delta_offsets, r.delta_s, r.rate_per_s) for r in got] == [
        (0, 60, 0.0), (1, 300, 1 / 300), (0, 60, 0.0)]
