"""Round-robin merge of ordered tables, and n-per-group limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulary.operators.numbering import number_rows

#: Up to this size the optimizer limits each task's rows per group before the shuffle.
PLANNED_GROUP_LIMIT = 1000


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "round"
) -> DataFrame:
    """The first ``n`` rows of every group with their 1-based rank; ``order`` must be total.

    For a small ``n`` each task forwards at most ``n`` rows per group. For a larger one rows
    are numbered by range parts, so that a group of any size is spread over many tasks.
    """
    if n > PLANNED_GROUP_LIMIT:
        numbered = number_rows(df, order, keys, name)
        return numbered.filter(F.col(name) <= n).withColumn(name, F.col(name).cast("int"))
    group = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(group)).filter(F.col(name) <= n)


def round_robin(ranked: DataFrame, limit: int, rank: str = "round", turn: str = "turn") -> DataFrame:
    """First rows of every table in turn order, then second rows, up to ``limit``."""
    return ranked.orderBy(rank, turn).limit(limit)
