"""Tumbling-window counts over the request log: sessions, calls, search phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What names a row of each table, for upserts of windows that are still open.
TIMING_KEYS = ("window_start", "window_end")
SESSION_KEYS = (*TIMING_KEYS, "protocol_version", "client_name", "client_version")
CALL_KEYS = (*TIMING_KEYS, "tool", "status")


def _windowed(df: DataFrame, ts: str, size: str, watermark: str | None) -> tuple[DataFrame, Column]:
    """The frame with its watermark (streams only) and the window to group by."""
    if df.isStreaming and watermark is not None:
        df = df.withWatermark(ts, watermark)
    return df, F.window(F.col(ts), size)


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest
    )


def session_counts(
    sessions: DataFrame, ts: str = "ts", size: str = "1 hour", watermark: str | None = "1 hour"
) -> DataFrame:
    """Sessions opened per window, protocol and client."""
    df, window = _windowed(sessions, ts, size, watermark)
    grouped = df.groupBy(window, "protocol_version", "client_name", "client_version")
    return _flat(grouped.agg(F.count("*").alias("sessions")))


def call_metrics(
    calls: DataFrame, ts: str = "ts", size: str = "1 hour", watermark: str | None = "1 hour"
) -> DataFrame:
    """Calls, errors and duration per window, tool and status."""
    df, window = _windowed(calls, ts, size, watermark)
    grouped = df.groupBy(window, "tool", "status")
    return _flat(
        grouped.agg(
            F.count("*").alias("calls"),
            F.count("error_code").alias("errors"),
            F.sum("duration_ms").alias("total_ms"),
            F.max("duration_ms").alias("max_ms"),
        )
    )


def search_timings(
    timings: DataFrame, ts: str = "ts", size: str = "1 hour", watermark: str | None = "1 hour"
) -> DataFrame:
    """Searches per window with total and maximum time of each phase."""
    df, window = _windowed(timings, ts, size, watermark)
    phases = ("discovery_ms", "fan_out_ms", "post_filter_ms")
    measures = [f(c).alias(f"{n}_{c}") for c in phases for n, f in (("sum", F.sum), ("max", F.max))]
    return _flat(df.groupBy(window).agg(F.count("*").alias("searches"), *measures))
