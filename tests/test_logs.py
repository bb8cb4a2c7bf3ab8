from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabulary.operators import metrics, quality
from tabulary.sources import column_types, request_log, samples, sinks
from tabulary.streaming import runner, windows


def write(path, header, lines):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


MEMORY = {
    "mixed": (["1.0,102400", "2.0,-1", "3.0,104448", "4.0,-1", "5.0,-1"], (102.0, 2, 3)),
    "all_sentinels": (["1.0,-1", "2.0,-1", "3.0,-1"], (0.0, 0, 3)),
    "all_valid": (["1.0,100000", "2.0,102400", "3.0,104448"], (102.0, 3, 0)),
    "malformed": (["1.0,100000", "bad,not-a-number", "2.0", "", "3.0,104448.9,x"], (102.0, 2, 0)),
}


@pytest.mark.parametrize("case", MEMORY)
def test_memory_samples(spark, tmp_path, case):
    lines, expected = MEMORY[case]
    path = write(tmp_path / "rss.csv", "wall_ts,rss_kb", lines)
    got = metrics.memory_summary(samples.read_memory(spark, path)).first()
    assert tuple(got) == expected


def test_latency_samples(spark, tmp_path):
    lines = [
        "1.0,200,0.050,ok", "2.0,200,0.060,", "3.0,429,0.001,rate_limited", "4.0,200,n/a,ok",
        "5.0,200,0.5", "6.0,200,0.070, ", "7.0,200,0.080,ok,extra", '8.0,-3,0.09,"a,b"',
    ]
    path = write(tmp_path / "latency.csv", "wall_ts,status,duration_seconds,error_class", lines)
    rows = samples.read_latency(spark, path)
    got = sorted((round(r["duration_ms"], 6), r["error_class"]) for r in rows.collect())
    assert got == [
        (1.0, "rate_limited"), (50.0, "ok"), (60.0, "ok"), (70.0, "ok"), (80.0, "ok"), (90.0, "a,b"),
    ]
    assert rows.agg(F.min("ts")).first()[0] == datetime(1970, 1, 1, 0, 0, 1)


@pytest.mark.parametrize(
    ("status", "expected"),
    [(200, "ok"), (299, "ok"), (429, "rate_limited"), (500, "5xx"), (404, "4xx"), (302, "unknown"),
     (-1, "pool_timeout"), (-2, "request_timeout"), (-3, "other")],
)
def test_error_classes(spark, status, expected):
    df = spark.createDataFrame([(status,)], "s int")
    assert df.select(metrics.error_class(F.col("s"))).first()[0] == expected


def test_a_failure_keeps_its_name(spark):
    df = spark.createDataFrame([(-3, "ReadError")], "s int, f string")
    got = df.select(metrics.error_class(F.col("s"), F.col("f"))).first()[0]
    assert got == "ReadError"


def summaries(spark, durations, kbs):
    latency = spark.createDataFrame([(float(d),) for d in durations], "duration_ms double")
    memory = spark.createDataFrame([(k,) for k in kbs], "rss_kb long")
    return metrics.latency_summary(latency), metrics.memory_summary(memory)


def broken(spark, durations, kbs, **limits):
    found = metrics.breaches(*summaries(spark, durations, kbs), **limits)
    return sorted(r["metric"] for r in found.collect())


def test_gate(spark):
    assert broken(spark, [50, 60], [100_000]) == []
    assert broken(spark, [50, 60], []) == []
    assert broken(spark, [50, 60], [-1, -1]) == ["memory_not_evaluated"]
    assert broken(spark, [301, 1501], [300 * 1024]) == ["max_rss_mb", "p50_ms", "p95_ms"]
    assert broken(spark, [], []) == []
    assert broken(spark, [300] * 10, [256 * 1024, -1]) == []


def test_summary_files(spark, tmp_path):
    latency, memory = summaries(spark, [500, 2000], [1024, -1])
    errors = metrics.error_summary(spark.createDataFrame([("ok",), ("odd",)], "error_class string"))
    table = metrics.summary_metrics(latency, memory, errors)
    sinks.write_metrics(table, str(tmp_path / "m"), "json")
    back = {r["metric"]: r["value"] for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert back["latency_p50_ms"] == 2000.0 and back["memory_sentinels"] == 1.0
    assert (back["errors_n_ok"], back["errors_n_other"], back["errors_n_5xx"]) == (1.0, 1.0, 0.0)
    sinks.write_summary(table, metrics.breaches(latency, memory), str(tmp_path / "s"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert "- latency_p50_ms: 2000.0" in lines
    assert lines[-1] == "- breach: p95_ms=2000.0 > limit 1500"
    with pytest.raises(ValueError):
        sinks.write_metrics(table, str(tmp_path / "x"), "xml")


def rejected(spark, *slots):
    rows = [(datetime.fromisoformat(t), "rate_limited") for t, n in slots for _ in range(n)]
    rows.append((datetime(2026, 1, 1, 12), "ok"))
    df = spark.createDataFrame(rows, "ts timestamp, error_class string")
    return metrics.rejections_per(df, "ts")


ROLLOVER = {
    "drop": ([("2026-01-01 23:59:30", 10), ("2026-01-02 00:00:30", 4)], True, "drop of more than half at midnight"),
    "half": ([("2026-01-01 23:59:30", 10), ("2026-01-02 00:00:30", 5)], False, "no drop of more than half at midnight"),
    "gap": ([("2026-01-01 23:58:30", 10), ("2026-01-02 00:00:30", 1)], False, "no drop of more than half at midnight"),
    "no_midnight": ([("2026-01-01 23:58:30", 10)], False, "no midnight in the data"),
    "nothing": ([], False, "no rejections"),
}


@pytest.mark.parametrize("case", ROLLOVER)
def test_rollover(spark, case):
    slots, observed, reason = ROLLOVER[case]
    got = metrics.rollover_summary(rejected(spark, *slots)).first()
    assert (got["observed"], got["reason"]) == (observed, reason)


def test_request_mix(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "tool string")
    got = {r["tool"]: r["share"] for r in metrics.request_mix(df).collect()}
    assert got == {"a": 0.75, "b": 0.25}


def test_log_lines_keep_the_locked_fields_only(spark, tmp_path):
    raw = spark.createDataFrame(
        [("r1", "search", "db", "t", 5, "ok", None, "203.0.113.9", "secret words")],
        "request_id string, tool string, database string, table string, duration_ms long, "
        "status string, error_code string, ip string, query string",
    )
    lines = request_log.anonymize(raw, F.col("ip"))
    assert tuple(lines.columns) == request_log.CALL_FIELDS
    assert lines.first()["ip_prefix"] == "203.0.113"
    lines.write.json(str(tmp_path / "log"))
    assert request_log.read_log(spark, str(tmp_path / "log")).count() == 1
    stream = request_log.stream_log(spark, str(tmp_path / "log"))
    assert "ip" not in stream.columns
    streamed = runner.run_available(stream.select("request_id", "tool"), "test-log")
    assert [tuple(r) for r in streamed.collect()] == [("r1", "search")]
    found = quality.leaks(lines.withColumn("line", F.to_json(F.struct("*"))), "tool", "line", ["secret", "search"])
    assert [tuple(r) for r in found.collect()] == [("search", "search", 1)]


def test_a_later_run_appends_what_is_new(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "table")

    def run():
        stream = runner.stream_table(spark, folder, "*.parquet")
        return sorted(r["id"] for r in runner.run_available(stream, "again", out).collect())

    spark.range(25).write.parquet(folder)
    assert run() == list(range(25))
    spark.range(25, 65).write.mode("append").parquet(folder)
    assert run() == list(range(65))
    assert run() == list(range(65))


def test_retention_prunes_days(spark, tmp_path):
    df = spark.range(40).select("id", F.expr("timestamp'2026-01-01' + make_interval(0,0,0,id)").alias("ts"))
    assert request_log.retained(df).count() == 31
    request_log.write_by_day(df, str(tmp_path / "days"))
    kept = request_log.retained_days(spark, str(tmp_path / "days"))
    assert kept.count() == 31
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_column_types(spark):
    rows = [("news", '{"title": "TEXT", "n": "INTEGER"}'), ("bad", "{oops"), ("none", None)]
    df = spark.createDataFrame(rows, "resource_name string, column_definitions string")
    types = column_types.column_types(df)
    assert column_types.types_of(types, "news") == {"title": "TEXT", "n": "INTEGER"}
    assert column_types.types_of(types, "bad") == {}


def test_changed_text(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "z")], "id int, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "Y"), (5, "z")], "id int, t string")
    assert tuple(quality.changed_text(a, b, ["id"], "t", "t").first()) == (3, 1, 2)
    assert quality.uncited(spark.createDataFrame([("",), (None,), ("c",)], "_citation string")).count() == 2


CALL_FILES = [
    [("2026-01-01 00:10:00", "s", "ok"), ("2026-01-01 00:50:00", "s", "error")],
    [("2026-01-01 05:10:00", "s", "ok"), ("2026-01-01 05:20:00", "f", "ok")],
    [("2026-01-01 05:30:00", "s", "ok"), ("2026-01-01 05:31:00", None, "ok")],
    [("2026-01-01 09:00:00", "f", "ok")],
    [("2026-01-01 00:20:00", "s", "ok")],
    [("2026-01-01 09:10:00", "f", "ok")],
]


def _write_calls(spark, folder, rows):
    df = spark.createDataFrame(rows, "at string, tool string, status string").select(
        F.col("at").cast("timestamp").alias("ts"), "tool", "status",
        F.when(F.col("status") == "error", "not_found").alias("error_code"),
        F.lit(7).cast("long").alias("duration_ms"),
    )
    df.coalesce(1).write.mode("append").parquet(folder)


def _call_rows(df):
    return sorted(
        (r["window_start"].hour, r["tool"] or "", r["status"], r["calls"], r["errors"], r["total_ms"])
        for r in df.collect()
    )


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    """One file per batch; the fifth is behind the watermark by then, so its row is dropped."""
    folder = str(tmp_path / "in")
    for rows in CALL_FILES:
        _write_calls(spark, folder, rows)
    for snapshot in (2, 50):
        stream = runner.stream_table(spark, folder, "*.parquet", files_per_batch=1)
        got = runner.run_upserts(windows.call_metrics(stream), "test-calls", windows.CALL_KEYS, snapshot=snapshot)
        assert _call_rows(got) == [
            (0, "s", "error", 1, 1, 7), (0, "s", "ok", 1, 0, 7), (5, "", "ok", 1, 0, 7),
            (5, "f", "ok", 1, 0, 7), (5, "s", "ok", 2, 0, 14), (9, "f", "ok", 2, 0, 14),
        ]
    assert windows.call_metrics(spark.read.parquet(folder)).agg(F.sum("calls")).first()[0] == 9


def test_upserts_go_on_and_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "calls")

    def run():
        stream = runner.stream_table(spark, folder, "*.parquet", files_per_batch=1)
        return _call_rows(runner.run_upserts(windows.call_metrics(stream), "x", windows.CALL_KEYS, out, 3))

    _write_calls(spark, folder, CALL_FILES[0])
    assert run() == [(0, "s", "error", 1, 1, 7), (0, "s", "ok", 1, 0, 7)]
    _write_calls(spark, folder, [("2026-01-01 00:55:00", "s", "ok")])
    whole = [(0, "s", "error", 1, 1, 7), (0, "s", "ok", 2, 0, 14)]
    assert run() == whole
    # the last batch as after a failure between its write and its commit
    commits = tmp_path / "calls-progress" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)
    assert run() == whole and run() == whole


def test_no_input_gives_no_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    _write_calls(spark, folder, [])
    stream = runner.stream_table(spark, folder, "*.parquet")
    assert runner.run_upserts(windows.call_metrics(stream), "none", windows.CALL_KEYS).collect() == []
