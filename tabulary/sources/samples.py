"""CSV files of latency and memory samples. Malformed lines are skipped, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt_record"
# The columns of the two sample files.
LATENCY_COLUMNS = ("wall_ts", "status", "duration_seconds", "error_class")
MEMORY_COLUMNS = ("wall_ts", "rss_kb")


def _read(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as text; short lines are dropped, surplus fields ignored."""
    fields = [T.StructField(c, T.StringType()) for c in (*columns, _CORRUPT)]
    lines = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(path)
    )
    short = F.size(F.split(F.col(_CORRUPT), ",", -1)) < len(columns)
    return lines.filter(~F.coalesce(short, F.lit(False))).drop(_CORRUPT)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """(ts, status, duration_ms, error_class); blank classes are ``ok``."""
    rows = _read(spark, path, LATENCY_COLUMNS)
    seconds = F.col("duration_seconds").try_cast("double")
    label = F.trim(F.coalesce("error_class", F.lit("")))
    return rows.select(
        F.col("wall_ts").try_cast("double").cast("timestamp").alias("ts"),
        F.col("status").try_cast("int").alias("status"),
        (seconds * 1000.0).alias("duration_ms"),
        F.when(label == "", "ok").otherwise(label).alias("error_class"),
    ).filter("duration_ms IS NOT NULL")


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """(ts, rss_kb); negative values are failed polls and stay for counting."""
    rows = _read(spark, path, MEMORY_COLUMNS)
    return rows.select(
        F.col("wall_ts").try_cast("double").cast("timestamp").alias("ts"),
        F.col("rss_kb").try_cast("double").cast("long").alias("rss_kb"),
    ).filter("rss_kb IS NOT NULL")


def write_samples(df: DataFrame, path: str) -> None:
    """Samples as headed CSV files, one per task."""
    df.write.option("header", True).csv(path)
