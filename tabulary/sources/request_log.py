"""The request log: JSON lines with locked field sets, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.functions.network import ip_prefix

# The locked fields of the three events.
CALL_FIELDS = (
    "request_id",
    "tool",
    "database",
    "table",
    "duration_ms",
    "status",
    "ip_prefix",
    "error_code",
)
SESSION_FIELDS = ("request_id", "ip_prefix", "protocol_version", "client_name", "client_version")
SEARCH_FIELDS = (
    "request_id",
    "ip_prefix",
    "tool",
    "discovery_ms",
    "fan_out_ms",
    "post_filter_ms",
)
#: Days a log line is kept.
RETENTION_DAYS = 30
#: Files a stream takes up at a time, which bounds its batches and what one key brings to one.
FILES_PER_BATCH = 100


def _schema(fields: tuple[str, ...]) -> str:
    typed = [f"`{f}` {'long' if f.endswith('_ms') else 'string'}" for f in fields]
    return ", ".join(["ts timestamp", "event string", *typed])


CALL_SCHEMA = _schema(CALL_FIELDS)
SESSION_SCHEMA = _schema(SESSION_FIELDS)
SEARCH_SCHEMA = _schema(SEARCH_FIELDS)


def read_log(spark: SparkSession, path: str, schema: str = CALL_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_log(
    spark: SparkSession,
    path: str,
    schema: str = CALL_SCHEMA,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def anonymize(raw: DataFrame, ip: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Only the locked fields, with the address cut to its prefix."""
    return raw.withColumn("ip_prefix", ip_prefix(ip)).select(*extra, *CALL_FIELDS)


def retained(log: DataFrame, ts: str = "ts", days: int = RETENTION_DAYS) -> DataFrame:
    """Lines no older than ``days`` before the newest one."""
    newest = log.agg(F.max(ts)).scalar()
    return log.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {int(days)} DAYS"))


def write_by_day(log: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Day-partitioned Parquet, so retention drops folders and never rewrites rows."""
    log.withColumn("dt", F.to_date(ts)).write.mode(mode).partitionBy("dt").parquet(path)


def retained_days(spark: SparkSession, path: str, days: int = RETENTION_DAYS) -> DataFrame:
    """The day folders within retention; older ones are pruned without being read."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("dt")).scalar()
    return stored.filter(F.col("dt") >= F.date_sub(newest, int(days)))
