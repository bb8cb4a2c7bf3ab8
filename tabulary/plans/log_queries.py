"""Request-log metrics over the events table read as a log of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.operators import metrics, percentiles
from tabulary.plans.catalogue import query, table
from tabulary.session import work_path
from tabulary.sources import request_log, samples, sinks

#: Status of each event read as a response, and the class it falls in.
_STATUS = {"click": 200, "view": -2, "purchase": 404, "error": 429, "signup": 503}
_CLASS = {
    "click": "ok", "view": "request_timeout", "purchase": "4xx", "error": "rate_limited",
    "signup": "5xx",
}


def _case(values: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items())
    return f"CASE event_type {arms} END"


_CLASS_SQL = _case(_CLASS)


def _calls(spark, sf):
    events = table(spark, sf, "telemetry.events")
    statuses = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    return events.select(
        "event_id", "ts", "event_type", F.col("value").alias("duration_ms"),
        F.get(F.map_values(F.map_filter(statuses, lambda k, v: k == F.col("event_type"))), F.lit(0))
        .alias("status"),
    ).withColumn("error_class", metrics.error_class(F.col("status")))


@query(f"SELECT event_id, {_case(_STATUS)} AS status, {_CLASS_SQL} AS error_class FROM events")
def error_classes(spark, sf):
    return _calls(spark, sf).select("event_id", "status", "error_class")


@query(f"SELECT {_CLASS_SQL} AS error_class, count(*) AS n FROM events GROUP BY 1")
def error_counts(spark, sf):
    return metrics.error_counts(_calls(spark, sf))


_SUMMARY = ", ".join(
    f"count(*) FILTER ({_CLASS_SQL} = '{c}') AS n_{c}" for c in metrics.ERROR_CLASSES
)


@query(f"SELECT {_SUMMARY}, CAST(0 AS BIGINT) AS n_other FROM events")
def error_summary(spark, sf):
    return metrics.error_summary(_calls(spark, sf))


_LATENCY = (
    "SELECT max(value) FILTER (rn = CAST(floor(0.5 * n) AS BIGINT) + 1) AS p50_ms, "
    "max(value) FILTER (rn = CAST(floor(0.95 * n) AS BIGINT) + 1) AS p95_ms, "
    "max(value) AS max_ms, count(*) AS samples FROM (SELECT value, "
    "row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events)"
)


@query(_LATENCY)
def latency_summary(spark, sf):
    return metrics.latency_summary(_calls(spark, sf))


@query(
    "SELECT event_type, p, value FROM (SELECT event_type, value, row_number() OVER "
    "(PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n "
    "FROM events) JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.9), (0.95), (0.99)) q(p) "
    "ON rn = CAST(floor(p * n) AS BIGINT) + 1"
)
def percentiles_by_tool(spark, sf):
    calls = _calls(spark, sf).withColumnRenamed("duration_ms", "d")
    return percentiles.exact_percentiles(calls, "d", (0.5, 0.9, 0.95, 0.99), ["event_type"])


@query(
    "SELECT p, l_extendedprice AS value FROM (SELECT l_extendedprice, row_number() OVER "
    "(ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem) JOIN "
    "(VALUES (CAST(0.0 AS DOUBLE)), (0.5), (0.95)) q(p) ON rn = CAST(floor(p * n) AS BIGINT) + 1"
)
def percentiles_of_all(spark, sf):
    lines = table(spark, sf, "sales.lineitem")
    return percentiles.exact_percentiles(lines, "l_extendedprice", (0.0, 0.5, 0.95))


@query(
    "SELECT event_type, p, true AS within FROM (SELECT DISTINCT event_type FROM events "
    "WHERE value IS NOT NULL) CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.95)) q(p)"
)
def percentiles_approximate(spark, sf):
    """Whether each answer's rank lies within one in 10,000 of the wanted one, and one more."""
    calls = _calls(spark, sf).filter("duration_ms IS NOT NULL")
    found = percentiles.approx_percentiles(calls, "duration_ms", (0.5, 0.95), ["event_type"])
    ranks = (
        calls.join(F.broadcast(found), "event_type")  # two rows per event type
        .groupBy("event_type", "p")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("duration_ms") < F.col("value")).alias("below"),
            F.count_if(F.col("duration_ms") <= F.col("value")).alias("upto"),
        )
    )
    wanted, slack = F.col("p") * F.col("n"), F.col("n") / 10_000 + 1
    within = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return ranks.select("event_type", "p", within.alias("within"))


_HOURLY = (
    "SELECT date_trunc('hour', ts) AS slot, count(*) AS n FROM events "
    "WHERE event_type = 'error' GROUP BY 1"
)


@query(
    "SELECT date_trunc('minute', ts) AS slot, count(*) AS n FROM events "
    "WHERE event_type = 'error' GROUP BY 1"
)
def rejections_per_minute(spark, sf):
    return metrics.rejections_per(_calls(spark, sf), "ts").select(
        F.col("slot").cast("timestamp_ntz").alias("slot"), "n"
    )


_ROLLOVERS = (
    f"SELECT m.slot, m.n, b.n AS n_before, m.n < 0.5 * b.n AS rollover FROM ({_HOURLY}) m "
    f"JOIN ({_HOURLY}) b ON b.slot = m.slot - INTERVAL 1 HOUR "
    "WHERE m.slot = date_trunc('day', m.slot)"
)


@query(_ROLLOVERS)
def midnight_rollovers(spark, sf):
    hourly = metrics.rejections_per(_calls(spark, sf), "ts", "hour")
    found = metrics.rollovers(hourly, "hour")
    return found.withColumn("slot", F.col("slot").cast("timestamp_ntz"))


@query(
    f"SELECT coalesce((SELECT bool_or(rollover) FROM ({_ROLLOVERS})), false) AS observed, "
    f"(SELECT count(*) FROM ({_HOURLY}) WHERE slot = date_trunc('day', slot)) AS midnights"
)
def rollover_summary(spark, sf):
    hourly = metrics.rejections_per(_calls(spark, sf), "ts", "hour")
    return metrics.rollover_summary(hourly, "hour").select("observed", "midnights")


def _memory(spark, sf):
    """Samples as text: one kilobyte figure per event, failed polls and broken lines."""
    return table(spark, sf, "telemetry.events").select(
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("wall_ts"),
        F.when(F.col("event_type") == "error", "-1")
        .when(F.col("event_type") == "signup", "not-a-number")
        .otherwise(F.floor(F.col("value") * 10).cast("string"))
        .alias("rss_kb"),
    )


_MEMORY = (
    "SELECT max(CASE WHEN event_type NOT IN ('error', 'signup') "
    "THEN CAST(floor(value * 10) AS BIGINT) END) / 1024.0 AS max_rss_mb, "
    "count(*) FILTER (event_type NOT IN ('error', 'signup')) AS samples, "
    "count(*) FILTER (event_type = 'error') AS sentinels FROM events"
)


@query(_MEMORY)
def memory_summary(spark, sf):
    """Written as CSV and read back through the memory source."""
    path = work_path(spark, "memory-csv")
    samples.write_samples(_memory(spark, sf), path)
    return metrics.memory_summary(samples.read_memory(spark, path))


@query(
    "SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second, "
    f"{_case(_STATUS)} AS status, value * 1000.0 AS duration_ms, "
    f"CASE event_type WHEN 'click' THEN 'ok' ELSE {_CLASS_SQL} END AS error_class "
    "FROM events WHERE event_type <> 'signup'"
)
def latency_file(spark, sf):
    """Written as CSV with blank classes and broken lines, read through the latency source."""
    calls = _calls(spark, sf)
    lines = calls.select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("wall_ts"),
        "status",
        F.when(F.col("event_type") == "signup", "n/a")
        .otherwise(F.col("duration_ms").cast("string"))
        .alias("duration_seconds"),
        F.when(F.col("error_class") == "ok", "").otherwise(F.col("error_class"))
        .alias("error_class"),
    )
    path = work_path(spark, "latency-csv")
    samples.write_samples(lines, path)
    return samples.read_latency(spark, path).select(
        F.unix_seconds("ts").alias("second"), "status", "duration_ms", "error_class"
    )


@query(
    f"SELECT metric, observed, threshold FROM (SELECT 'p50_ms' AS metric, p50_ms AS observed, "
    f"CAST(10 AS DOUBLE) AS threshold FROM ({_LATENCY}) UNION ALL SELECT 'p95_ms', p95_ms, "
    f"100000 FROM ({_LATENCY}) UNION ALL SELECT 'memory_not_evaluated', count(*), 0 "
    "FROM events WHERE event_type = 'error') WHERE observed > threshold"
)
def threshold_breaches(spark, sf):
    calls = _calls(spark, sf)
    unanswered = calls.filter("event_type = 'error'").select(F.lit(-1).alias("rss_kb"))
    return metrics.breaches(
        metrics.latency_summary(calls), metrics.memory_summary(unanswered),
        max_p50_ms=10, max_p95_ms=100_000,
    )


@query(
    "SELECT event_type AS tool, count(*) AS n, "
    "count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE) AS share FROM events GROUP BY 1"
)
def request_mix(spark, sf):
    return metrics.request_mix(table(spark, sf, "telemetry.events"), "event_type")


@query(
    f"SELECT 'latency_' || metric AS metric, value FROM (UNPIVOT (SELECT p50_ms, p95_ms, max_ms, "
    f"CAST(samples AS DOUBLE) AS samples FROM ({_LATENCY})) ON p50_ms, p95_ms, max_ms, samples "
    "INTO NAME metric VALUE value) UNION ALL "
    "SELECT 'memory_' || metric, value FROM (UNPIVOT (SELECT CAST(max_rss_mb AS DOUBLE) "
    "AS max_rss_mb, CAST(samples AS DOUBLE) AS samples, CAST(sentinels AS DOUBLE) AS sentinels "
    f"FROM ({_MEMORY})) ON max_rss_mb, samples, sentinels INTO NAME metric VALUE value) UNION ALL "
    f"SELECT 'errors_n_' || {_CLASS_SQL}, CAST(count(*) AS DOUBLE) FROM events GROUP BY 1 "
    "UNION ALL SELECT metric, value FROM (VALUES ('errors_n_pool_timeout', CAST(0 AS DOUBLE)), "
    "('errors_n_other', 0)) z(metric, value)"
)
def summary_sink(spark, sf):
    """All summaries written as (metric, value) and read back."""
    calls = _calls(spark, sf)
    path = work_path(spark, "summary")
    long_form = metrics.summary_metrics(
        metrics.latency_summary(calls), memory_summary(spark, sf), metrics.error_summary(calls)
    )
    sinks.write_metrics(long_form, path)
    return spark.read.parquet(path)


def _raw_log(spark, sf):
    """The events as raw call lines, with a full address and a field that must not survive."""
    return table(spark, sf, "telemetry.events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit("tool_call").alias("event"),
        F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("event_type").alias("tool"),
        F.lit("telemetry").alias("database"),
        F.lit("events").alias("table"),
        F.floor("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.concat_ws(".", F.lit("10.1.2"), F.col("user_id") % 200).alias("ip"),
        F.when(F.col("event_type") == "error", "not_found").alias("error_code"),
        F.col("props").alias("arguments"),
    )


_LOG = (
    "SELECT 'req-' || event_id AS request_id, event_type AS tool, 'telemetry' AS database, "
    "'events' AS \"table\", CAST(floor(value) AS BIGINT) AS duration_ms, "
    "CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, "
    "'10.1.2' AS ip_prefix, CASE event_type WHEN 'error' THEN 'not_found' END AS error_code "
    "FROM events"
)


@query(_LOG)
def log_anonymized(spark, sf):
    return request_log.anonymize(_raw_log(spark, sf), F.col("ip"))


@query(_LOG)
def log_lines(spark, sf):
    """Anonymized lines written as JSON and read through the log source."""
    path = work_path(spark, "log-json")
    request_log.anonymize(_raw_log(spark, sf), F.col("ip"), ("ts", "event")).write.json(path)
    return request_log.read_log(spark, path).select(*request_log.CALL_FIELDS)


@query(
    "SELECT event_id, ts FROM events "
    "WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS"
)
def log_retained(spark, sf):
    return request_log.retained(table(spark, sf, "telemetry.events"), days=7).select(
        "event_id", "ts"
    )


@query(
    "SELECT event_id, ts FROM events "
    "WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7"
)
def log_days_retained(spark, sf):
    path = work_path(spark, "log-days")
    request_log.write_by_day(table(spark, sf, "telemetry.events").select("event_id", "ts"), path)
    return request_log.retained_days(spark, path, days=7).select("event_id", "ts")
