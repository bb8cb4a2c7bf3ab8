"""Calendar expressions in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_midnight(ts: Column) -> Column:
    """Whole seconds until the next 00:00 UTC, rounded up, never below one."""
    midnight = F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY")
    micros = F.timestamp_diff("MICROSECOND", ts, midnight)
    return F.greatest(F.lit(1).cast("long"), F.ceil(micros / F.lit(1_000_000)).cast("long"))
