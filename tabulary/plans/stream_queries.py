"""Quota decisions and windowed log counts, replayed and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.plans.catalogue import query, table
from tabulary.streaming import quota, runner, windows

#: Small figures that suit the sparse test log.
QUOTA = quota.Quota(burst=2.0, per_second=1 / 21600, daily_limit=4, idle_ttl_seconds=None)
FORGETFUL = quota.Quota(burst=2.0, per_second=1 / 86400, daily_limit=3, idle_ttl_seconds=7200.0)
_DAY = 86_400_000_000


def _quota_sql(q: quota.Quota, source: str = "events", key: str = "user_id") -> str:
    """The bucket as a recursive query: one step per request of a key."""
    rate = repr(float(q.per_second))
    if q.idle_ttl_seconds is None:
        fresh = "false"
    else:
        idle = f"s.seen + {int(q.idle_ttl_seconds * 1_000_000)}"
        fresh = (
            f"(e.us > CASE WHEN s.locked THEN greatest({idle}, (s.seen // {_DAY} + 1) * {_DAY}) "
            f"ELSE {idle} END)"
        )
    return f"""
WITH RECURSIVE e AS (
  SELECT event_id, {key} AS k, epoch_us(ts) AS us, epoch_us(ts) // {_DAY} AS day,
         row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM {source}
), s AS (
  SELECT event_id, k, rn, us AS seen, us AS refilled, day, true AS allowed,
         CAST(0 AS BIGINT) AS wait, CAST({q.burst} AS DOUBLE) - 1 AS tokens,
         CAST({q.burst} AS DOUBLE) - 1 AS tokens_left, CAST(1 AS BIGINT) AS n,
         1 >= {q.daily_limit} AS locked FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, k, rn, us, CASE WHEN ok OR fresh THEN us ELSE refilled END, day, ok,
         CASE WHEN ok THEN 0 ELSE greatest(1,
           CASE WHEN t < 1 THEN CAST(ceil((1 - t) / {rate}) AS BIGINT) ELSE 1 END,
           CASE WHEN l THEN CAST(ceil(((day + 1) * {_DAY} - us) / 1e6) AS BIGINT) ELSE 1 END) END,
         CASE WHEN ok THEN t - 1 WHEN fresh THEN t ELSE tokens END,
         CASE WHEN ok THEN t - 1 ELSE t END, CASE WHEN ok THEN c + 1 ELSE c END,
         l OR (ok AND c + 1 >= {q.daily_limit})
  FROM (SELECT *, t >= 1 AND c < {q.daily_limit} AS ok FROM (
    SELECT e.event_id, e.k, e.rn, e.us, e.day, s.refilled, s.tokens, {fresh} AS fresh,
      CASE WHEN {fresh} THEN CAST({q.burst} AS DOUBLE) ELSE
        least(CAST({q.burst} AS DOUBLE), s.tokens + (e.us - s.refilled) / 1e6 * {rate}) END AS t,
      CASE WHEN {fresh} OR e.day > s.day THEN 0 ELSE s.n END AS c,
      CASE WHEN {fresh} OR e.day > s.day THEN false ELSE s.locked END AS l
    FROM s JOIN e ON e.k = s.k AND e.rn = s.rn + 1))
)
SELECT event_id, allowed, wait AS retry_after, round(tokens_left, 6) AS tokens_left FROM s"""


def _decisions(df):
    return df.select(
        "event_id", "allowed", "retry_after", F.round("tokens_left", 6).alias("tokens_left")
    )


def _requests(spark, sf):
    return table(spark, sf, "telemetry.events").select("event_id", "user_id", "ts")


@query(_quota_sql(QUOTA))
def quota_replay(spark, sf):
    return _decisions(quota.replay(_requests(spark, sf), "user_id", "ts", "event_id", QUOTA))


@query(_quota_sql(FORGETFUL))
def quota_replay_with_eviction(spark, sf):
    return _decisions(quota.replay(_requests(spark, sf), "user_id", "ts", "event_id", FORGETFUL))


@query(_quota_sql(QUOTA, "(SELECT *, 1 AS one FROM events)", "one"))
def quota_replay_one_key(spark, sf):
    """All requests on one key: the busiest key there can be."""
    requests = _requests(spark, sf).withColumn("one", F.lit(1))
    return _decisions(quota.replay(requests, "one", "ts", "event_id", QUOTA))


@query(
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) "
    "ORDER BY ts, event_id) <= 4 AS allowed FROM events"
)
def daily_quota(spark, sf):
    decided = quota.daily_quota(_requests(spark, sf), "user_id", "ts", "event_id", 4)
    return decided.select("event_id", "user_id", "allowed")


_IP = "'10.0.' || (user_id // 250) || '.' || (user_id % 250)"


@query(
    "WITH d AS (" + _quota_sql(
        QUOTA, "(SELECT * FROM events WHERE event_type NOT IN ('signup', 'purchase'))"
    ) + ") SELECT event_id, allowed, retry_after, tokens_left FROM d UNION ALL "
    "SELECT event_id, true, 0, NULL FROM events WHERE event_type IN ('signup', 'purchase')"
)
def quota_with_bypass(spark, sf):
    """Loopback and authenticated requests skip the bucket and rejoin after it."""
    user = F.col("user_id")
    address = F.concat_ws(".", F.lit("10.0"), F.floor(user / 250), user % 250)
    events = table(spark, sf, "telemetry.events").select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "signup", "127.0.0.1").otherwise(address).alias("ip"),
        (F.col("event_type") == "purchase").alias("authenticated"),
    )
    metered, free = quota.split_bypass(events, "ip", "authenticated")
    decided = quota.replay(metered, "quota_key", "ts", "event_id", QUOTA).drop("quota_key")
    return _decisions(decided.unionByName(quota.bypass_decisions(free)))


def _event_stream(spark, sf):
    stream = runner.stream_table(spark, sf, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(_quota_sql(QUOTA))
def quota_stream(spark, sf):
    stream = _event_stream(spark, sf).select("event_id", "user_id", "ts")
    decided = quota.stream_quota(stream, "user_id", "ts", "event_id", QUOTA)
    return _decisions(runner.run_available(decided, "quota"))


def _plain_times(df):
    return df.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    )


_WINDOW = (
    "date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end"
)


def _sessions(events):
    return events.filter("event_type = 'signup'").select(
        "ts",
        F.lit("2025-06-18").alias("protocol_version"),
        F.col("event_type").alias("client_name"),
        F.get_json_object("props", "$.k").alias("client_version"),
    )


_SESSION_SQL = (
    f"SELECT {_WINDOW}, '2025-06-18' AS protocol_version, event_type AS client_name, "
    "json_extract_string(props, '$.k') AS client_version, count(*) AS sessions "
    "FROM events WHERE event_type = 'signup' GROUP BY ALL"
)


@query(_SESSION_SQL)
def session_stream(spark, sf):
    counted = windows.session_counts(_sessions(_event_stream(spark, sf)), size="1 day")
    return _plain_times(runner.run_upserts(counted, "sessions", windows.SESSION_KEYS))


@query(_SESSION_SQL)
def session_counts(spark, sf):
    counted = windows.session_counts(_sessions(table(spark, sf, "telemetry.events")), size="1 day")
    return _plain_times(counted)


def _calls(events):
    failed = F.col("event_type") == "error"
    return events.select(
        "ts",
        F.col("event_type").alias("tool"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed, "not_found").alias("error_code"),
        F.floor("value").alias("duration_ms"),
    )


_CALL_SQL = (
    f"SELECT {_WINDOW}, event_type AS tool, "
    "CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, count(*) AS calls, "
    "count(*) FILTER (event_type = 'error') AS errors, "
    "CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms, "
    "max(CAST(floor(value) AS BIGINT)) AS max_ms FROM events GROUP BY ALL"
)


@query(_CALL_SQL)
def call_stream(spark, sf):
    counted = windows.call_metrics(_calls(_event_stream(spark, sf)), size="1 day")
    return _plain_times(runner.run_upserts(counted, "calls", windows.CALL_KEYS))


@query(_CALL_SQL)
def call_metrics(spark, sf):
    counted = windows.call_metrics(_calls(table(spark, sf, "telemetry.events")), size="1 day")
    return _plain_times(counted)


@query(
    f"SELECT {_WINDOW}, count(*) AS searches, "
    + ", ".join(
        f"CAST(sum(CAST(floor(value * {m}) AS BIGINT)) AS BIGINT) AS sum_{c}, "
        f"max(CAST(floor(value * {m}) AS BIGINT)) AS max_{c}"
        for c, m in (("discovery_ms", 1), ("fan_out_ms", 4), ("post_filter_ms", 2))
    )
    + " FROM events GROUP BY ALL"
)
def search_timing_stream(spark, sf):
    timings = _event_stream(spark, sf).select(
        "ts",
        F.floor("value").alias("discovery_ms"),
        F.floor(F.col("value") * 4).alias("fan_out_ms"),
        F.floor(F.col("value") * 2).alias("post_filter_ms"),
    )
    counted = windows.search_timings(timings, size="1 day")
    return _plain_times(runner.run_upserts(counted, "timings", windows.TIMING_KEYS))
