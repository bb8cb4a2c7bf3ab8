"""The schema registry table: one JSON object of column types per table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.functions.json_args import map_column


def column_types(
    registry_rows: DataFrame,
    name: str = "resource_name",
    definitions: str = "column_definitions",
) -> DataFrame:
    """(table, column, type); rows with malformed definitions contribute nothing."""
    return registry_rows.select(
        F.col(name).alias("table"), F.explode(map_column(F.col(definitions))).alias("column", "type")
    )


def types_of(types: DataFrame, table: str) -> dict[str, str]:
    """One table's types for use beside its schema; bounded by its column count."""
    rows = types.filter(F.col("table") == table).select("column", "type").collect()
    return {r["column"]: r["type"] for r in rows}
