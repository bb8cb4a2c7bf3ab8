"""Counts of many tables in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.session import local_frame


def labelled_counts(
    parts: Sequence[tuple[str, DataFrame]], label: str, name: str = "n"
) -> DataFrame:
    """(label, name): rows per frame, zero included.

    All frames feed one grouped count, combined before its shuffle, instead of one
    single-row aggregate each.
    """
    if len(parts) == 1:
        text, df = parts[0]
        return df.agg(F.count("*").alias(name)).select(F.lit(text).alias(label), name)
    spark = parts[0][1].sparkSession
    rows = reduce(
        DataFrame.unionByName, [df.select(F.lit(text).alias(label)) for text, df in parts]
    )
    counted = rows.groupBy(label).agg(F.count("*").alias("_n"))
    listed = local_frame(spark, [(text,) for text, _ in parts], f"`{label}` string")
    return listed.join(counted, label, "left").select(
        label, F.coalesce("_n", F.lit(0)).alias(name)
    )
