"""Registered tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.registry import TableSpec


@lru_cache(maxsize=1024)
def _stored_schema(application: str, path: str) -> T.StructType:
    """A table's schema is read from its files once per application."""
    return SparkSession.active().read.parquet(path).schema


def open_table(spark: SparkSession, base: str, spec: TableSpec) -> DataFrame:
    """A lazy scan of the table with its row restriction and derived columns."""
    path = f"{base}/{spec.path or spec.name + '.parquet'}"
    schema = _stored_schema(spark.sparkContext.applicationId, path)
    df = spark.read.schema(schema).parquet(path)
    if spec.where:
        df = df.filter(spec.where)
    if spec.first_by:
        # reduced within each task before the shuffle, however many rows a key has
        row = F.min_by(F.struct(*df.columns), F.struct(spec.first_by, *df.columns)).alias("_row")
        df = df.groupBy(*spec.key).agg(row).select("_row.*")
    if spec.derived:
        df = df.select("*", *[F.expr(e).alias(c) for c, e in spec.derived.items()])
    return df


def opener(spark: SparkSession, base: str) -> Callable[[str, TableSpec], DataFrame]:
    return lambda database, spec: open_table(spark, base, spec)
