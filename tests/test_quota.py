from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tabulary.streaming import quota, runner
from tabulary.streaming.quota import Bucket, Quota, decide

SECOND = 1_000_000
NOON = int(datetime(2026, 1, 1, 12, tzinfo=UTC).timestamp()) * SECOND
LONG = Quota(idle_ttl_seconds=None)


def run(times, limits=LONG, bucket=None):
    out = []
    for t in times:
        bucket, allowed, wait, _ = decide(bucket, t, limits)
        out.append((allowed, wait))
    return out, bucket


def test_burst_of_twenty_then_reject():
    out, _ = run([NOON] * 21)
    assert out == [(True, 0)] * 20 + [(False, 1)]


def test_one_token_a_second():
    out, _ = run([NOON] * 21 + [NOON + SECOND, NOON + 2 * SECOND])
    assert out[20:] == [(False, 1), (True, 0), (True, 0)]


def drained_day():
    return [NOON] * 20 + [NOON + i * SECOND for i in range(1, 4981)]


def test_five_thousand_a_day():
    out, bucket = run(drained_day())
    assert all(a for a, _ in out) and len(out) == 5000
    assert bucket.count == 5000 and bucket.locked
    (last,), _ = run([NOON + 4981 * SECOND], bucket=bucket)
    assert last[0] is False and last[1] > 1


def test_midnight_resets_the_day():
    _, bucket = run(drained_day())
    midnight = (NOON // quota._DAY + 1) * quota._DAY
    out, bucket = run([midnight + SECOND], bucket=bucket)
    assert out == [(True, 0)] and (bucket.count, bucket.locked) == (1, False)


def test_the_longer_wait_is_reported():
    at = int(datetime(2026, 1, 1, 23, 55, tzinfo=UTC).timestamp()) * SECOND
    locked = Bucket(0.0, at - SECOND // 2, 5000, at // quota._DAY, at - SECOND // 2, True)
    assert decide(locked, at, LONG)[1:3] == (False, 300)
    empty = Bucket(0.0, at, 10, at // quota._DAY, at, False)
    assert decide(empty, at, Quota(per_second=1 / 60, idle_ttl_seconds=None))[1:3] == (False, 60)


def test_idle_buckets_are_forgotten_but_locked_ones_last_until_midnight():
    limits = Quota(daily_limit=3)
    _, bucket = run([NOON] * 2, limits)
    later = NOON + 901 * SECOND
    assert decide(bucket, later, limits)[0].count == 1
    assert decide(bucket, NOON + 899 * SECOND, limits)[0].count == 3
    _, locked = run([NOON] * 3, limits)
    assert decide(locked, NOON + 6 * 3600 * SECOND, limits)[1] is False
    assert decide(locked, NOON + 13 * 3600 * SECOND, limits)[1] is True


def requests(spark, seed, n=4000, hot=0.7, spread=3 * 86400):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(40)}"
        rows.append((i, key, start + timedelta(seconds=rng.randrange(spread))))
    return rows, spark.createDataFrame(rows, "id int, key string, ts timestamp")


def by_hand(rows, limits):
    out, buckets = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        now = int(ts.replace(tzinfo=UTC).timestamp()) * SECOND
        buckets[key], allowed, wait, left = decide(buckets.get(key), now, limits)
        out[i] = (allowed, wait, left)
    return out


def decided(df):
    return {r["id"]: (r["allowed"], r["retry_after"], r["tokens_left"]) for r in df.collect()}


@pytest.mark.parametrize(
    "limits",
    [
        Quota(3, 1 / 120, 300, None),
        Quota(5, 1 / 30, 100, 600.0),
        Quota(2, 1 / 7, 100_000, None),
        Quota(40, 1 / 1000, 50, None),
    ],
)
@pytest.mark.parametrize("hot", [0.0, 0.7, 1.0])
def test_replay_equals_one_sequential_pass(spark, many_parts, limits, hot):
    rows, df = requests(spark, seed=f"{limits}{hot}", hot=hot)
    assert decided(quota.replay(df, "key", "ts", "id", limits)) == by_hand(rows, limits)


LIMITS = [
    Quota(3, 1 / 120, 300, None), Quota(5, 1 / 30, 100, 600.0), Quota(2, 1 / 7, 10**6, None),
    Quota(20, 1.0, 5000, 900.0), Quota(1, 1 / 86400, 2, 50.0), Quota(2, 1.0, 0, None),
    Quota(0.5, 1.0, 5, None), Quota(7, 3.3, 40, 3.0),
]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("step", [0.001, 1, 60, 2000])
def test_a_long_run_equals_single_decisions(limits, step):
    rng = random.Random(f"{limits}{step}")
    times, at = [], NOON
    for _ in range(2500):
        at += int(rng.expovariate(1.0) * step * SECOND) * rng.choice((0, 1, 1, 1, 20))
        times.append(at)
    bucket, singles = None, []
    for t in times:
        bucket, *rest = decide(bucket, t, limits)
        singles.append(tuple(rest))
    state, got = None, []
    for chunk in (times[:900], times[900:920], times[920:]):
        state, *arrays = quota.decide_run(state, np.array(chunk), limits)
        got += list(zip(*(a.tolist() for a in arrays), strict=True))
    assert got == singles and state == bucket


def test_replay_keeps_requests_without_a_key(spark):
    df = spark.createDataFrame(
        [(1, None, datetime(2026, 1, 1)), (2, None, datetime(2026, 1, 1))],
        "id int, key string, ts timestamp",
    )
    got = quota.replay(df, "key", "ts", "id", Quota(1, 1.0, 10, None))
    assert [r["allowed"] for r in got.orderBy("id").collect()] == [True, False]
    assert got.columns[:3] == ["id", "key", "ts"]


def test_daily_quota_splits_nothing(spark):
    rows, df = requests(spark, seed=2, n=5000, hot=0.8)
    for limit in (7, 1200):
        got = {r["id"]: r["allowed"] for r in quota.daily_quota(df, "key", "ts", "id", limit).collect()}
        seen: dict = {}
        for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
            seen[key, ts.date()] = seen.get((key, ts.date()), 0) + 1
            assert got[i] is (seen[key, ts.date()] <= limit)


def test_loopback_and_authenticated_requests_bypass(spark):
    df = spark.createDataFrame(
        [("127.0.0.1", None), ("::1", False), ("10.0.0.1", True), ("[::2]", False), ("", None)],
        "ip string, soak boolean",
    )
    metered, free = quota.split_bypass(df, "ip", "soak")
    assert sorted(r["quota_key"] for r in metered.collect()) == ["::2", "_unknown"]
    assert free.count() == 3
    assert quota.bypass_decisions(free).filter("allowed").count() == 3


def test_stream_in_many_batches_equals_replay(spark, tmp_path):
    """Files in time order, one per micro-batch: state carries over between batches."""
    limits = Quota(3, 1 / 120, 60, None)
    rows, df = requests(spark, seed=9, n=1200, hot=0.5)
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    folder = tmp_path / "in"
    for n in range(4):
        part = spark.createDataFrame(ordered[n * 300 : (n + 1) * 300], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    stream = runner.stream_table(spark, str(folder), "*.parquet", files_per_batch=1)
    got = quota.stream_quota(stream, "key", "ts", "id", limits)
    table = runner.run_available(got, "test-quota")
    assert decided(table) == by_hand(rows, limits)


def test_requests_without_a_key_share_one_quota(spark, tmp_path):
    start = datetime(2026, 1, 1, 6)
    rows = [(i, None if i % 3 else "a", start + timedelta(seconds=i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    for limit in (2, 1500):
        got = {r["id"]: r["allowed"] for r in quota.daily_quota(df, "key", "ts", "id", limit).collect()}
        own = [i for i in range(12) if i % 3]
        assert got == {i: (i in own[:limit]) or (i % 3 == 0 and i // 3 < limit) for i in range(12)}
    limits = Quota(100, 1.0, 2, None)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = runner.stream_table(spark, str(tmp_path / "in"), "*.parquet")
    table = runner.run_available(quota.stream_quota(stream, "key", "ts", "id", limits), "test-null")
    assert table.columns == ["id", "key", "ts", "allowed", "retry_after", "tokens_left"]
    assert decided(table) == decided(quota.replay(df, "key", "ts", "id", limits))


def test_stream_forgets_idle_keys(spark, tmp_path):
    limits = Quota(2, 1 / 86400, 10, 600.0)
    start = datetime(2026, 1, 1, 6)
    batches = [
        [(1, "a", start), (2, "a", start), (3, "a", start)],
        [(4, "b", start + timedelta(hours=5))],
        [(5, "a", start + timedelta(hours=6))],
    ]
    folder = tmp_path / "in"
    for rows in batches:
        df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    stream = runner.stream_table(spark, str(folder), "*.parquet", files_per_batch=1)
    got = runner.run_available(quota.stream_quota(stream, "key", "ts", "id", limits), "test-idle")
    assert {r["id"]: r["allowed"] for r in got.collect()} == {
        1: True, 2: True, 3: False, 4: True, 5: True,
    }


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_replay_takes_as_many_jobs_for_many_parts_as_for_few(spark, many_parts):
    """One key under steady load: every part depends on the one before it."""
    limits = Quota(3, 1 / 7, 10**6, None)
    start = datetime(2026, 1, 1)
    rows = [(i, "hot", start + timedelta(seconds=2 * i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp")
    expected, jobs = by_hand(rows, limits), []
    for parts in (4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            jobs.append(_jobs(spark, f"replay-{parts}", lambda: decided(quota.replay(df, "key", "ts", "id", limits))))
            assert decided(quota.replay(df, "key", "ts", "id", limits)) == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert jobs[0] == jobs[1]


@pytest.mark.parametrize("limits", [Quota(3, 1 / 600, 5, None), Quota(2, 1 / 7200, 4, 900.0), Quota(1, 1.0, 2, 30.0)])
def test_a_rest_over_midnight_makes_the_bucket_certain(limits):
    rng = random.Random(f"{limits}")
    for _ in range(300):
        times, at = [], NOON + rng.randrange(20 * 3600) * SECOND
        for _ in range(40):
            at += rng.choice((1, 5, 60, 700, 3600, 8 * 3600)) * SECOND
            times.append(at)
        times = np.array(times)
        for cut in np.flatnonzero(quota._certain(times, limits)) + 1:
            whole, *all_ = quota.decide_run(None, times, limits)
            fresh, *rest = quota.decide_run(None, times[cut:], limits)
            assert all((a[cut:] == r).all() for a, r in zip(all_, rest, strict=True))


def test_a_key_with_very_many_requests_in_one_batch(spark, tmp_path):
    """Forty frames of one key, rows out of order: decided in time order, frame by frame."""
    limits = Quota(5, 1 / 3, 2000, None)
    n = 40_000
    spark.range(n).selectExpr(
        "int(id) as id", "if(id % 50 = 0, concat('k', id % 7), 'hot') as key",
        f"timestamp_micros({NOON} + (id * 7919 % {n}) * 1000000) as ts", "repeat('x', 100) as payload",
    ).repartition(3).write.parquet(str(tmp_path / "in"))
    rows = [(r.id, r.key, r.ts) for r in spark.read.parquet(str(tmp_path / "in")).collect()]
    stream = runner.stream_table(spark, str(tmp_path / "in"), "*.parquet", files_per_batch=10)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        table = runner.run_available(quota.stream_quota(stream, "key", "ts", "id", limits), "test-many")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert decided(table) == by_hand(rows, limits)


def test_frames_wait_in_the_store_and_not_in_the_task():
    """A million requests of one key, a fifth of a gigabyte: the task keeps some numbers of each."""
    import pickle
    import tracemalloc

    class Store(dict):
        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    meter = quota.Meter(Quota(20, 1.0, 5000, None), "id", ["id", "_at", "payload"])
    frame = pd.DataFrame({"id": np.arange(10_000), "_at": NOON + np.arange(10_000), "payload": "x" * 200})
    stored = pickle.dumps(frame)

    class Disk(Store):
        def updateValue(self, key, value):  # what a frame takes is not the task's
            self[key] = True

        def getValue(self, key):
            return (stored,)

    meter.waiting = Disk()
    tracemalloc.start()
    made = sum(len(f) for f in meter._decide_many(None, (frame.copy() for _ in range(100))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 1_000_000 and peak < 200_000_000


@pytest.mark.parametrize("limits", [Quota(3, 1 / 40, 60, None), Quota(2, 1 / 90, 20, 300.0)])
def test_a_call_decides_all_keys_of_a_group(limits):
    """Two batches of several frames, keys mixed and out of order; idle buckets are then forgotten."""
    from types import SimpleNamespace

    class Store(dict):
        updateValue, getValue, removeKey, iterator = dict.__setitem__, dict.get, dict.__delitem__, dict.items

    timers, store = [], Store()
    meter = quota.Meter(limits, "id", ["id", "_at", "_key", "_group"])
    meter.buckets, meter.waiting = store, Store()
    meter.handle = SimpleNamespace(listTimers=lambda: list(timers), registerTimer=timers.append)
    rng, start = random.Random(5), NOON
    known, expected, got, last = {}, {}, {}, NOON
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    for batch in range(2):
        rows = [(batch * 1000 + i, start + rng.randrange(2000) * SECOND, f"k{rng.randrange(9)}", 7) for i in range(600)]
        start += 2000 * SECOND
        for i, at, key, _ in sorted(rows, key=lambda r: (r[1], r[0])):
            known[key], *expected[i] = quota.decide(known.get(key), at, limits)
            last = max(last, at)
        frames = [pd.DataFrame(rows[n : n + 250], columns=["a", "b", "c", "d"]) for n in range(0, 600, 250)]
        for frame in meter.handleInputRows((7,), iter(frames), watermark):
            assert list(frame.columns) == ["id", "_at", "_key", "allowed", "retry_after", "tokens_left"]
            got |= {r.id: [r.allowed, r.retry_after, r.tokens_left] for r in frame.itertuples()}
        assert not meter.waiting
    assert got.keys() == expected.keys()
    for i, (allowed, wait, left) in expected.items():
        assert got[i][:2] == [allowed, wait] and got[i][2] == pytest.approx(left)
    assert {k[0]: Bucket(*v) for k, v in store.items()}.keys() == known.keys()
    if limits.idle_ttl_seconds is None:
        assert not timers
        return
    assert len(timers) == 1
    for ahead, left in ((0, True), (2 * 86_400_000, False)):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: last // 1000 + ahead)  # noqa: B023
        list(meter.handleExpiredTimer((7,), now, None))
        assert bool(store) == left
    assert len(timers) == 2 and timers[1] >= last // 1000 + 300_000
