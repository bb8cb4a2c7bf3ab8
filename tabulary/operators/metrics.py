"""Request-log metrics: latency, error classes, memory samples, rollover, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.operators.percentiles import percentile_row

# Error classes a summary lists even when they did not occur.
ERROR_CLASSES = ("ok", "rate_limited", "pool_timeout", "request_timeout", "5xx", "4xx")
# Thresholds of the gate (milliseconds, milliseconds, megabytes).
MAX_P50_MS, MAX_P95_MS, MAX_RSS_MB = 300, 1500, 256


def error_class(status: Column, failure: Column | None = None) -> Column:
    """Class of a response status; negative codes mark failures on the client's side."""
    other = F.lit("other") if failure is None else F.coalesce(failure, F.lit("other"))
    return (
        F.when(status == -1, "pool_timeout")
        .when(status == -2, "request_timeout")
        .when(status < 0, other)
        .when(status.between(200, 299), "ok")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "5xx")
        .when(status.between(400, 499), "4xx")
        .otherwise("unknown")
    )


def latency_summary(samples: DataFrame, value: str = "duration_ms") -> DataFrame:
    """p50, p95, max and sample count; zeros when there is none."""
    spread = percentile_row(samples, value, (0.50, 0.95))
    totals = samples.agg(
        F.coalesce(F.max(F.col(value).cast("double")), F.lit(0.0)).alias("max_ms"),
        F.count(value).alias("samples"),
    )
    # Both sides are single-row aggregates; the totals are read as one scalar.
    both = totals.select(F.struct("max_ms", "samples")).scalar()
    return spread.select(
        F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"), both["max_ms"], both["samples"]
    ).toDF("p50_ms", "p95_ms", "max_ms", "samples")


def error_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("error_class").agg(F.count("*").alias("n"))


def error_summary(samples: DataFrame) -> DataFrame:
    """One row: a count for each listed class, zero included, and the rest as ``other``."""
    name = F.col("error_class")
    listed = [F.count_if(name == c).alias(f"n_{c}") for c in ERROR_CLASSES]
    return samples.agg(*listed, F.count_if(~name.isin(*ERROR_CLASSES)).alias("n_other"))


def memory_summary(samples: DataFrame, value: str = "rss_kb") -> DataFrame:
    """Peak over real samples; negative sentinels are counted apart."""
    kb = F.col(value)
    return samples.agg(
        F.coalesce(F.max(F.when(kb >= 0, kb)) / 1024.0, F.lit(0.0)).alias("max_rss_mb"),
        F.count_if(kb >= 0).alias("samples"),
        F.count_if(kb < 0).alias("sentinels"),
    )


def rejections_per(samples: DataFrame, ts: str, grain: str = "minute") -> DataFrame:
    """Rejected requests per time slot."""
    return (
        samples.filter(F.col("error_class") == "rate_limited")
        .groupBy(F.date_trunc(grain, F.col(ts)).alias("slot"))
        .agg(F.count("*").alias("n"))
    )


def rollovers(per_slot: DataFrame, grain: str = "minute") -> DataFrame:
    """Midnight slots with the slot before: did rejections drop below half?

    The slot before is matched by time, so a gap in the data matches nothing.
    """
    step = F.expr(f"INTERVAL 1 {grain.upper()}")
    before = per_slot.select((F.col("slot") + step).alias("slot"), F.col("n").alias("n_before"))
    at_midnight = per_slot.filter(F.col("slot") == F.date_trunc("day", F.col("slot")))
    return at_midnight.join(before, "slot").select(
        "slot", "n", "n_before", (F.col("n") < 0.5 * F.col("n_before")).alias("rollover")
    )


def rollover_summary(per_slot: DataFrame, grain: str = "minute") -> DataFrame:
    """One row: whether any midnight shows a rollover, and why not otherwise."""
    seen = per_slot.agg(
        F.count("*").alias("slots"),
        F.count_if(F.col("slot") == F.date_trunc("day", F.col("slot"))).alias("midnights"),
    )
    observed = rollovers(per_slot, grain).agg(
        F.coalesce(F.bool_or("rollover"), F.lit(False)).alias("observed")
    )
    flag = observed.scalar()
    return seen.select(
        flag.alias("observed"),
        "midnights",
        F.when(F.col("slots") == 0, "no rejections")
        .when(F.col("midnights") == 0, "no midnight in the data")
        .when(flag, "drop of more than half at midnight")
        .otherwise("no drop of more than half at midnight")
        .alias("reason"),
    )


def breaches(
    latency: DataFrame,
    memory: DataFrame,
    max_p50_ms: float = MAX_P50_MS,
    max_p95_ms: float = MAX_P95_MS,
    max_rss_mb: float = MAX_RSS_MB,
) -> DataFrame:
    """One row per broken threshold; no row means the gate passes.

    Memory that was polled but never answered is a breach of its own, not a pass.
    """

    def rule(name: str, observed: Column, limit: float, broken: Column) -> Column:
        return F.when(
            broken,
            F.struct(
                F.lit(name).alias("metric"),
                observed.cast("double").alias("observed"),
                F.lit(float(limit)).alias("threshold"),
            ),
        )

    p50, p95 = F.col("p50_ms"), F.col("p95_ms")
    slow = latency.select(
        F.array(
            rule("p50_ms", p50, max_p50_ms, p50 > max_p50_ms),
            rule("p95_ms", p95, max_p95_ms, p95 > max_p95_ms),
        ).alias("rules")
    )
    rss, unanswered = F.col("max_rss_mb"), (F.col("samples") == 0) & (F.col("sentinels") > 0)
    heavy = memory.select(
        F.array(
            rule("max_rss_mb", rss, max_rss_mb, rss > max_rss_mb),
            rule("memory_not_evaluated", F.col("sentinels"), 0, unanswered),
        ).alias("rules")
    )
    return (
        slow.unionByName(heavy)
        .select(F.explode("rules").alias("breach"))
        .filter("breach IS NOT NULL")
        .select("breach.*")
    )


def request_mix(calls: DataFrame, tool: str = "tool") -> DataFrame:
    """Observed share of requests per tool."""
    per_tool = calls.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("n"))
    total = per_tool.agg(F.sum("n")).scalar()
    return per_tool.select("tool", "n", (F.col("n") / total).alias("share"))


def summary_metrics(latency: DataFrame, memory: DataFrame, errors: DataFrame) -> DataFrame:
    """All one-row summaries as (metric, value), ready for a sink."""

    def long_form(df: DataFrame, prefix: str) -> DataFrame:
        pairs = [
            F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in df.columns
        ]
        return df.select(F.inline(F.array(*pairs)))

    return (
        long_form(latency, "latency_")
        .unionByName(long_form(memory, "memory_"))
        .unionByName(long_form(errors, "errors_"))
    )
