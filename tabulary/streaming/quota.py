"""Per-key request quotas: a token bucket and a daily count, in batch and on a stream."""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from tabulary.functions.network import UNKNOWN_KEY, ip_key, is_loopback
from tabulary.operators.merge import first_per_group
from tabulary.session import ensure_checkpoint_dir, local_frame

# The functions here travel to the Python workers whole, so executors need no copy of the
# package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SECOND = 1_000_000
_DAY = 86_400 * _SECOND


@dataclass(frozen=True)
class Quota:
    """Burst size, refill per second, requests per UTC day, idle seconds before forgetting."""

    burst: float = 20.0
    per_second: float = 1.0
    daily_limit: int = 5_000
    idle_ttl_seconds: float | None = 900.0

    def __post_init__(self) -> None:
        # Stored state has a double column, which a whole number would not fill.
        object.__setattr__(self, "burst", float(self.burst))


class Bucket(NamedTuple):
    """State of one key: tokens as of the last allowed request, and the day's count.

    Times are microseconds since the epoch, ``day`` a day number. Rejected requests leave
    the tokens alone, so any number of them in a row can be decided at once.
    """

    tokens: float
    refilled: int
    count: int
    day: int
    seen: int
    locked: bool


STATE_SCHEMA = "tokens double, refilled long, count long, day long, seen long, locked boolean"
_DECISION = [
    T.StructField("allowed", T.BooleanType()),
    T.StructField("retry_after", T.LongType()),
    T.StructField("tokens_left", T.DoubleType()),
]


def expires(bucket: Bucket, quota: Quota) -> int | None:
    """When an idle key is forgotten; one locked for the day is kept until midnight."""
    if quota.idle_ttl_seconds is None:
        return None
    idle = bucket.seen + int(quota.idle_ttl_seconds * _SECOND)
    return max(idle, (bucket.seen // _DAY + 1) * _DAY) if bucket.locked else idle


def decide(bucket: Bucket | None, now: int, quota: Quota) -> tuple[Bucket, bool, int, float]:
    """One request at ``now``: (new state, allowed, seconds to wait if not, tokens left)."""
    today = now // _DAY
    if bucket is not None:
        deadline = expires(bucket, quota)
        if deadline is not None and now > deadline:
            bucket = None
    if bucket is None:
        bucket = Bucket(quota.burst, now, 0, today, now, False)
    base, refilled, count, day, _, locked = bucket
    if today > day:
        count, day, locked = 0, today, False
    tokens = base
    if now > refilled:
        tokens = min(quota.burst, base + (now - refilled) / _SECOND * quota.per_second)
    if tokens >= 1.0 and count < quota.daily_limit:
        count += 1
        locked = locked or count >= quota.daily_limit
        left = tokens - 1.0
        return Bucket(left, max(now, refilled), count, day, now, locked), True, 0, left
    wait = 1
    if tokens < 1.0:
        wait = max(wait, math.ceil((1.0 - tokens) / quota.per_second))
    if locked:
        wait = max(wait, -(-((today + 1) * _DAY - now) // _SECOND))
    return Bucket(base, refilled, count, day, now, locked), False, wait, tokens


def _rejected_until(bucket: Bucket, quota: Quota) -> int:
    """After a rejection: until when every further request is rejected as well.

    A little early rather than late, as the next request is decided on its own.
    """
    if bucket.locked:
        return (bucket.day + 1) * _DAY
    return bucket.refilled + int((1.0 - bucket.tokens) / quota.per_second * _SECOND) - 2


def decide_run(
    bucket: Bucket | None, times: np.ndarray, quota: Quota
) -> tuple[Bucket, np.ndarray, np.ndarray, np.ndarray]:
    """All requests of one key in time order; stretches of rejections are decided at once."""
    n = len(times)
    allowed, waits, left = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n)
    stops = np.array([], np.int64)
    if quota.idle_ttl_seconds is not None:
        stops = np.flatnonzero(np.diff(times) > quota.idle_ttl_seconds * _SECOND) + 1
    listed = times.tolist()
    i = 0
    while i < n:
        bucket, allowed[i], waits[i], left[i] = decide(bucket, listed[i], quota)
        i += 1
        if i == n or allowed[i - 1] or allowed[i - 2 : i - 1].any():
            continue  # a single rejection is not worth array arithmetic
        end = int(np.searchsorted(times, _rejected_until(bucket, quota)))
        if not bucket.locked:
            gap = int(np.searchsorted(stops, i))
            end = min(end, int(stops[gap])) if gap < len(stops) else end
        if end <= i:
            continue
        stretch = times[i:end]
        tokens = bucket.tokens + (stretch - bucket.refilled) / _SECOND * quota.per_second
        left[i:end] = np.minimum(quota.burst, tokens)
        short = np.ceil((1.0 - left[i:end]) / quota.per_second)
        waits[i:end] = np.where(left[i:end] < 1.0, np.maximum(1, short), 1)
        if bucket.locked:
            midnight = -(-((bucket.day + 1) * _DAY - stretch) // _SECOND)
            waits[i:end] = np.maximum(waits[i:end], midnight)
        bucket = bucket._replace(seen=listed[end - 1])
        i = end
    return bucket, allowed, waits, left


def _key_of(key: str) -> Column:
    """Requests without a key are metered together."""
    return F.coalesce(F.col(key).cast("string"), F.lit(UNKNOWN_KEY))


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def split_bypass(
    requests: DataFrame, ip: str, authenticated: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(metered with ``quota_key``, bypassing): loopback and authenticated calls bypass."""
    free = is_loopback(F.col(ip))
    if authenticated is not None:
        free = free | F.coalesce(F.col(authenticated), F.lit(False))
    metered = requests.filter(~free).withColumn("quota_key", ip_key(F.col(ip)))
    return metered, requests.filter(free)


def bypass_decisions(bypassing: DataFrame) -> DataFrame:
    """Bypassing requests in the shape of decided ones, for the union after the bucket."""
    return bypassing.select(
        "*",
        F.lit(True).alias("allowed"),
        F.lit(0).cast("long").alias("retry_after"),
        F.lit(None).cast("double").alias("tokens_left"),
    )


def replay(requests: DataFrame, key: str, ts: str, tiebreak: str, quota: Quota) -> DataFrame:
    """Decide every request of a log, in time order per key.

    The log is range-partitioned by (key, time), so a key with a large share of all
    requests is spread over many parts, and each part is walked in bounded batches. Only
    the bucket at a part boundary is carried over. How a part ends does not depend on how it
    starts if its last key begins in it, or if that key has a request before which the bucket
    is certainly full and the day new: one job finds these ends in all parts at once. What is
    left are stretches of parts, each within one key that never rests for a day's end; a
    second job walks each stretch once, times only. So the number of jobs does not depend on
    the number of parts.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    columns = requests.columns
    order = [F.col("_key"), F.col("_at"), F.col(tiebreak)]
    parts = (
        requests.withColumn("_key", _key_of(key))
        .withColumn("_at", _micros(ts))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    entry = _boundary_buckets(parts, quota)
    return _walk_parts(parts, quota, entry).select(*columns, *[f.name for f in _DECISION])


def _boundary_buckets(parts: DataFrame, quota: Quota) -> dict[int, tuple[str, tuple]]:
    """The (key, bucket) each part starts with, where its first key began in an earlier part.

    The driver holds one row per part and one bucket per boundary.
    """
    ends = parts.groupBy("_part").agg(F.min("_key").alias("first"), F.max("_key").alias("last"))
    spans = [tuple(r) for r in ends.orderBy("_part").collect()]
    pairs = list(zip(spans, spans[1:], strict=False))
    follows = {left[0]: right[0] for left, right in pairs if left[2] == right[1]}
    if not follows:
        return {}
    last_key = {part: last for part, _, last in spans}
    entered = set(follows.values())
    # their last key fills the part and began in an earlier one
    inside = {part for part, first, last in spans if first == last and part in entered}

    boundary = parts.select("_key", "_at", "_part").filter(
        F.col("_part").isin(sorted(follows)) & F.col("_key").isin(sorted({last_key[p] for p in follows}))
    )
    entry: dict[int, tuple[str, tuple]] = {}
    for r in _certain_exits(boundary, quota, inside).collect():
        entry[follows[r.part]] = (last_key[r.part], tuple(r)[1:])

    stretch: dict[int, int] = {}
    for part in sorted(follows):
        if follows[part] not in entry:
            stretch[part] = stretch.get(_before(part, follows), part)
    if stretch:
        for r in _walked_exits(boundary, quota, stretch, entry).collect():
            entry[follows[r.part]] = (last_key[r.part], tuple(r)[1:])
    return entry


def _before(part: int, follows: dict[int, int]) -> int | None:
    return next((p for p, q in follows.items() if q == part), None)


def _certain(times: np.ndarray, quota: Quota) -> np.ndarray:
    """Which requests of a key, but for the first, find a full bucket and an unused day in any case."""
    before, now = times[:-1], times[1:]
    gap = now - before
    rested = gap / _SECOND * quota.per_second >= quota.burst
    midnight = (before // _DAY + 1) * _DAY
    sure = rested & (now >= midnight)
    if quota.idle_ttl_seconds is not None:
        sure |= (gap > int(quota.idle_ttl_seconds * _SECOND)) & (now > midnight)
    return sure


def _certain_exits(boundary: DataFrame, quota: Quota, inside: set[int]) -> DataFrame:
    """The bucket after each part, of those whose bucket does not depend on earlier parts."""

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, key, bucket, last, known = None, None, None, None, False
        for pdf in batches:
            if pdf.empty:
                continue
            part = int(pdf["_part"].iloc[0])
            # only the last key's rows matter; an earlier key of the part may be at a boundary too
            mine = pdf["_key"] == pdf["_key"].iloc[-1]
            times = pdf.loc[mine, "_at"].to_numpy()
            if pdf["_key"].iloc[-1] != key:
                key, bucket, last, known = pdf["_key"].iloc[-1], None, None, part not in inside
            walked = times if last is None else np.append(last, times)
            cuts = np.flatnonzero(_certain(walked, quota)) + 1 - (len(walked) - len(times))
            if len(cuts):
                times, bucket, known = times[cuts[-1] :], None, True
            last = times[-1]
            if known:
                bucket, *_ = decide_run(bucket, times, quota)
        if known:
            yield pd.DataFrame([(part, *bucket)], columns=["part", *Bucket._fields])

    return boundary.mapInPandas(exits, f"part long, {STATE_SCHEMA}")


def _walked_exits(
    boundary: DataFrame, quota: Quota, stretch: dict[int, int], entry: dict[int, tuple[str, tuple]]
) -> DataFrame:
    """The bucket after each part of the stretches, every stretch walked in order by one task."""
    starts = {first: entry[first][1] for first in set(stretch.values())}

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, bucket = None, None
        for pdf in batches:
            parts, times = pdf["_part"].to_numpy(), pdf["_at"].to_numpy()
            edges = np.flatnonzero(np.append(True, parts[1:] != parts[:-1]))
            done = []
            for start, end in zip(edges, np.append(edges[1:], len(parts)), strict=True):
                if parts[start] != part:
                    if part is not None:
                        done.append((part, *bucket))
                    part = int(parts[start])
                    bucket = Bucket(*starts[part]) if part in starts else bucket
                bucket, *_ = decide_run(bucket, times[start:end], quota)
            if done:
                yield pd.DataFrame(done, columns=["part", *Bucket._fields])
        if part is not None:
            yield pd.DataFrame([(part, *bucket)], columns=["part", *Bucket._fields])

    spark = boundary.sparkSession
    first = local_frame(spark, sorted(stretch.items()), "_part int, _stretch int")  # one row a part
    walk = boundary.join(F.broadcast(first), "_part").select("_stretch", "_part", "_at")
    return (
        walk.repartition("_stretch").sortWithinPartitions("_stretch", "_part", "_at")
        .mapInPandas(exits, f"part long, {STATE_SCHEMA}")
    )


def _buckets(
    batches: Iterator[pd.DataFrame], quota: Quota, entry: dict[int, tuple[str, tuple]]
) -> Iterator[tuple[pd.DataFrame, Bucket]]:
    """Walk one sorted part a batch at a time: (batch with decisions, bucket after it)."""
    current, bucket, started = None, None, False
    for pdf in batches:
        if pdf.empty:
            continue
        if not started:
            started = True
            key, state = entry.get(int(pdf["_part"].iloc[0]), (None, None))
            current, bucket = key, Bucket(*state) if state else None
        keys, times = pdf["_key"].to_numpy(), pdf["_at"].to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        decided = []
        for start, end in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            if keys[start] != current:
                current, bucket = keys[start], None
            bucket, *arrays = decide_run(bucket, times[start:end], quota)
            decided.append(arrays)
        allowed, waits, left = (np.concatenate(part) for part in zip(*decided, strict=True))
        yield pdf.assign(allowed=allowed, retry_after=waits, tokens_left=left), bucket


def _walk_parts(parts: DataFrame, quota: Quota, entry: dict) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _ in _buckets(batches, quota, entry):
            yield pdf

    return parts.mapInPandas(rows, T.StructType([*parts.schema.fields, *_DECISION]))


def daily_quota(
    requests: DataFrame, key: str, ts: str, tiebreak: str, limit: int
) -> DataFrame:
    """Quota without the bucket: the first ``limit`` requests per key and UTC day pass.

    Only the ``limit``-th request of each full day is looked up and compared with. Requests
    without a key share one.
    """
    day, own = F.to_date(ts), _key_of(key)
    order = [F.col(ts).asc(), F.col(tiebreak).asc()]
    slim = requests.select(own.alias("_key"), day.alias("_day"), ts, tiebreak)
    reached = first_per_group(slim, ["_key", "_day"], order, limit)
    cut = reached.filter(F.col("round") == limit).select(
        "_key", "_day", F.struct(ts, tiebreak).alias("_cut")
    )
    same = (own == F.col("_key")) & (day == F.col("_day"))
    within = F.col("_cut").isNull() | (F.struct(ts, tiebreak) <= F.col("_cut"))
    return requests.join(cut, same, "left").select(
        *[requests[c] for c in requests.columns], within.alias("allowed")
    )


#: Groups of keys that a stream's state is held by, so the most tasks that can share a batch. Fixed for
#: the life of a stream's progress folder.
KEY_GROUPS = 1024


def stream_quota(
    requests: DataFrame,
    key: str,
    ts: str,
    tiebreak: str,
    quota: Quota,
    watermark: str = "1 hour",
) -> DataFrame:
    """Streaming form of :func:`replay`: decisions per micro-batch, one bucket per key.

    Requests without a key share one. Keys are dealt into ``KEY_GROUPS`` groups, which are decided
    together, so a batch costs a few calls a group and two small ones a key. The rows of a key that
    come in one batch are decided in time order: where a group has several frames they wait in the
    state store, by number, until the order of all is known, so a task holds one frame and some
    numbers a request however many there are. Idle buckets time out on event time; then requests
    later than the watermark are dropped and counted by the state operator's metrics. Without an
    idle time there is no time-out, and late requests are decided when they come.
    """
    fields = requests.schema.fields
    timed = requests.withWatermark(ts, watermark).withColumn("_at", _micros(ts)).withColumn("_key", _key_of(key))
    added = [T.StructField("_at", T.LongType()), T.StructField("_key", T.StringType())]
    out = T.StructType([*fields, *added, *_DECISION])
    grouped = timed.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(KEY_GROUPS))).groupBy("_group")
    decided = grouped.transformWithStateInPandas(
        Meter(quota, tiebreak, [*requests.columns, "_at", "_key", "_group"]), out, "append", "none" if quota.idle_ttl_seconds is None else "eventTime"
    )
    return decided.drop("_at", "_key")


class Meter(StatefulProcessor):
    """One bucket per key of a group, and an event timer that forgets those that have been idle.

    Without a column ``_key`` all rows are one key's.
    """

    def __init__(self, quota: Quota, tiebreak: str, columns: Sequence[str]):
        self.quota, self.tiebreak, self.columns = quota, tiebreak, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "key string", STATE_SCHEMA)
        self.waiting = handle.getMapState("waiting", "number long", "frame binary")

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        # frames come with names that are no Python identifiers replaced
        rows = (frame.set_axis(self.columns, axis=1).drop(columns="_group") for frame in rows)
        after = yield from self._decide_many(self._known, rows)
        for name, bucket in after.items():
            self.buckets.updateValue((name,), tuple(bucket))
        # a timer of an earlier batch stays: it looks at the buckets again when it fires
        if self.quota.idle_ttl_seconds is not None and next(iter(self.handle.listTimers()), None) is None:
            self._wake(min(expires(bucket, self.quota) for bucket in after.values()), timerValues)

    def _known(self, key: str) -> Bucket | None:
        known = self.buckets.getValue((key,))
        return Bucket(*known) if known is not None else None

    def _decide_many(self, known: Callable[[str], Bucket | None] | None, frames: Iterator[pd.DataFrame]):
        """Decide all requests in order, then hand out the frames as they came; returns the buckets by key."""
        numbers, sizes, order, single = {}, [], [], None
        for number, frame in enumerate(frames):
            if number == 0:
                single = frame
            else:
                if single is not None:
                    self.waiting.updateValue((0,), (pickle.dumps(single),))
                    single = None
                self.waiting.updateValue((number,), (pickle.dumps(frame),))
            sizes.append(len(frame))
            order.append(frame[["_at", self.tiebreak]].assign(_number=self._numbers(frame, numbers)))
        order = pd.concat(order, ignore_index=True).sort_values(["_number", "_at", self.tiebreak], kind="stable")
        times, place, owner = order["_at"].to_numpy(), order.index.to_numpy(), order["_number"].to_numpy()
        del order
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])).tolist()
        after, n = {}, len(times)
        decided = [np.empty(n, bool), np.empty(n, np.int64), np.empty(n)]
        for name, start, end in zip(numbers, starts, [*starts[1:], n], strict=True):
            bucket = known(name) if known is not None else None
            after[name], *values = decide_run(bucket, times[start:end], self.quota)
            for whole, part in zip(decided, values, strict=True):
                whole[place[start:end]] = part
        at = 0
        for number, size in enumerate(sizes):
            frame = single
            if frame is None:
                frame = pickle.loads(self.waiting.getValue((number,))[0])
                self.waiting.removeKey((number,))
            allowed, waits, left = (v[at : at + size] for v in decided)
            yield frame.assign(allowed=allowed, retry_after=waits, tokens_left=left)
            at += size
        return after

    def _numbers(self, frame: pd.DataFrame, numbers: dict[str | None, int]) -> np.ndarray:
        """The number of each row's key, which new keys are given in turn."""
        if "_key" not in self.columns:
            return np.full(len(frame), numbers.setdefault(None, 0), np.int32)
        own, names = pd.factorize(frame["_key"])
        return np.array([numbers.setdefault(name, len(numbers)) for name in names], np.int32)[own]

    def _wake(self, deadline: int, timerValues: TimerValues) -> None:
        self.handle.registerTimer(max(deadline // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        """Forget idle keys. The group is looked through once an idle time at most, as a bucket that is
        there too long is found expired when its key comes again."""
        now, gone, left = timerValues.getCurrentWatermarkInMs(), [], []
        for name, bucket in self.buckets.iterator():
            deadline = expires(Bucket(*bucket), self.quota)
            if deadline // 1000 >= now:
                left.append(deadline)
            else:
                gone.append(name)
        for name in gone:
            self.buckets.removeKey(name)
        if left:
            self._wake(max(min(left), now * 1000 + int(self.quota.idle_ttl_seconds * _SECOND)), timerValues)
        return iter(())

    def close(self) -> None:
        pass
