"""Where summaries go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(metrics: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Metrics as (metric, value) rows in Parquet, JSON or CSV."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError("fmt is parquet, json or csv")
    metrics.write.mode("overwrite").format(fmt).save(path)


def write_summary(metrics: DataFrame, breaches: DataFrame, path: str) -> None:
    """A readable list: one line per metric, then one per breach. A few dozen lines."""
    lines = metrics.select(
        F.lit(0).alias("part"),
        F.format_string("- %s: %.1f", "metric", "value").alias("value"),
    ).unionByName(
        breaches.select(
            F.lit(1).alias("part"),
            F.format_string(
                "- breach: %s=%.1f > limit %.0f", "metric", "observed", "threshold"
            ).alias("value"),
        )
    )
    lines.coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode(
        "overwrite"
    ).text(path)
