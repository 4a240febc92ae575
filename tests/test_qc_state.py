"""Q-C state: exact frames on dense, disordered input; cost by new seconds;
idle regions lose their state."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest

from freshstream.sources import event_log as EL
from freshstream.streaming import maintained as M
from freshstream.streaming import runner
from freshstream.streaming.qc_state import FRAME_MS, LastFiveMinutes, qc_stateful


class Map(dict):
    """A map state in memory that counts its traffic."""
    def __init__(self):
        self.reads = self.writes = self.removed = 0

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        self.reads += 1
        return self[k]

    def updateValue(self, k, v):
        self.writes += 1
        self[k] = v

    def removeKey(self, k):
        self.removed += 1
        del self[k]


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.map, self.value, self.timers = Map(), Value(), []

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def processor(timers=False):
    p, h = LastFiveMinutes(timers), Handle()
    p.init(h)
    return p, h


def feed(p, batch):
    pdf = pd.DataFrame(batch, columns=["ms", "cnt", "amounts", "cents"])
    out = list(p.handleInputRows(("r",), iter([pdf]), None))
    return tuple(int(out[0][c].iloc[0]) for c in ("event_count", "amounts", "total_cents", "max_ms")) if out else None


@pytest.mark.parametrize("seed,spread", [(1, 2_000), (2, 90_000), (3, 400_000), (4, 3_000_000)])
def test_frames_equal_brute_force(seed, spread):
    """Batches in any order around a moving time: late rows in and out of the
    frame, repeated milliseconds, rows exactly on both ends, big jumps."""
    rnd, (p, h), seen, now = random.Random(seed), processor(), [], 10_000_000
    for _ in range(120):
        now += rnd.choice([0, 1, 999, 1000, spread // 3, spread])
        batch = [(max(0, now + rnd.choice([0, -1, -FRAME_MS, -FRAME_MS - 1, -FRAME_MS + 1, -rnd.randrange(spread),
                                           rnd.randrange(50)])), 1, rnd.randint(0, 1), rnd.randrange(10_000))
                 for _ in range(rnd.randint(1, 12))]
        seen += batch
        top = max(b[0] for b in seen)
        frame = [b for b in seen if b[0] >= top - FRAME_MS]
        assert feed(p, batch) == (len(frame), sum(b[2] for b in frame), sum(b[3] for b in frame), top)
        assert sorted(m for v in h.map.values() for m in v[0]) == sorted({b[0] for b in frame})
        assert len(h.map) <= 302


def test_a_batch_touches_its_own_seconds_only():
    """A full frame of 300 seconds; then batches of one second each write one
    second and remove about one, however much the frame holds."""
    p, h = processor()
    feed(p, [(ms, 1, 1, 1) for ms in range(0, 300_000, 10)])
    for s in range(300, 340):
        h.map.reads = h.map.writes = h.map.removed = 0
        feed(p, [(s * 1000 + k, 1, 1, 1) for k in (1, 2, 3)])
        assert h.map.writes <= 3 and h.map.reads <= 5 and h.map.removed <= 2


def test_timer_follows_the_newest_event():
    p, h = processor(timers=True)
    feed(p, [(1000, 1, 1, 5)])
    feed(p, [(4000, 1, 1, 5)])
    feed(p, [(2000, 1, 1, 5)])
    assert h.timers == [4000 + FRAME_MS + 1]
    out = list(p.handleExpiredTimer(("r",), None, None))[0]
    assert (out.event_count[0], out.total_cents[0], out.max_ms[0]) == (0, 0, 4000)
    assert not h.map and not h.value.exists()


def rows(spark, spec):
    """(region, second, amount) -> log records."""
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    data = [(str(i), i, None if a is None else Decimal(a), r, "view", t0 + dt.timedelta(seconds=s), t0)
            for i, (r, s, a) in enumerate(spec)]
    df = spark.createDataFrame(data, "event_id string, user_id bigint, amount decimal(12,2), region string, "
                                     "event_type string, event_time timestamp, ingest_time timestamp")
    return EL.records_from_transactions(df)


def test_idle_region_shrinks_and_shows_nothing(spark, workdir):
    chunks = [[("eu", s, "1.00") for s in range(60)] + [("us", 0, "2.00"), ("us", 30, None)],
              [("us", s, "1.00") for s in range(60, 240, 10)],
              [("us", s, "1.00") for s in range(240, 420, 10)],
              [("us", s, "1.00") for s in range(420, 600, 10)]]
    log, sizes = f"{workdir}/log", []

    def sink(batch, batch_id):
        runner.batch_writer(f"{workdir}/out")(batch, batch_id)

    ckpt = None
    for i, c in enumerate(chunks):
        EL.append_chunk(rows(spark, c), log, i)
        q = runner.start(qc_stateful(M.typed_stream(spark, log), "10 seconds"), "idle", "update", sink,
                         checkpoint=ckpt or f"{workdir}/ckpt", state_partitions=2)
        assert q.awaitTermination(120) and q.exception() is None
        ckpt = f"{workdir}/ckpt"
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    out = spark.read.parquet(f"{workdir}/out").orderBy("batch_id").collect()
    last = {r.region: r for r in out}
    assert last["eu"].event_count == 0 and last["eu"].total_amount is None
    frame = [s for c in chunks for r, s, _ in c if r == "us" and s >= 590 - 300]
    assert last["us"].event_count == len(frame)
    eu = [r.event_count for r in out if r.region == "eu"]
    assert eu == [60, 0]                                   # once with its frame, once idle
    assert sizes[-1] < sizes[0] / 1.5                      # 60 seconds of eu are gone
