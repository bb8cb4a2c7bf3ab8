"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few narrow columns that every executor can hold without strain.
BROADCAST_ROWS = 100_000


def few_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def hinted(df: DataFrame, few: bool) -> DataFrame:
    """A broadcast hint for a side known to be small; otherwise the join shuffles."""
    return F.broadcast(df) if few else df
