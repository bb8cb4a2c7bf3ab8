"""Data-quality jobs: value leaks, untouched text, complete citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaks(logs: DataFrame, surface: str, text: str, canaries: Sequence[str]) -> DataFrame:
    """(surface, canary, rows): where a planted string shows up.

    The short list of canaries travels as a literal array, so rows are tested in place.
    """
    planted = F.array(*[F.lit(c) for c in canaries])
    found = F.filter(planted, lambda c: F.contains(F.col(text), c))
    return (
        logs.select(F.col(surface).alias("surface"), F.explode(found).alias("canary"))
        .groupBy("surface", "canary")
        .agg(F.count("*").alias("rows"))
    )


def changed_text(
    source: DataFrame, output: DataFrame, key: Sequence[str], source_text: str, output_text: str
) -> DataFrame:
    """One row: compared rows, rows whose text differs, and rows missing on either side."""
    left = source.select(*key, F.sha2(F.col(source_text), 256).alias("_a"), F.lit(1).alias("_l"))
    right = output.select(*key, F.sha2(F.col(output_text), 256).alias("_b"), F.lit(1).alias("_r"))
    both = left.join(right, list(key), "full_outer")
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count_if(present).alias("compared"),
        F.count_if(present & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
        F.count_if(~present).alias("missing"),
    )


def uncited(rows: DataFrame, citation: str = "_citation") -> DataFrame:
    """Rows without a citation."""
    return rows.filter(F.coalesce(F.col(citation), F.lit("")) == "")
