"""Catalog views: databases, tables, and one table's schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.operators.counts import labelled_counts
from tabulary.registry import Registry, TableSpec
from tabulary.session import local_frame

Opener = Callable[[str, TableSpec], DataFrame]

_DATABASES = "name string, description string, license string, license_url string"
_TABLES = (
    "database string, name string, hidden boolean, searchable boolean, "
    "upstream_description string, fallback_description string, ordinal int"
)


def databases_frame(spark: SparkSession, registry: Registry) -> DataFrame:
    rows = [(d.name, d.description, *d.license_pair()) for d in registry.databases.values()]
    return local_frame(spark, rows, _DATABASES)


def catalog_frame(spark: SparkSession, registry: Registry) -> DataFrame:
    """Every registered table with the flags that decide its visibility."""
    rows = [
        (d.name, t.name, t.hidden, bool(t.search_columns), t.upstream_description, t.description, i)
        for d in registry.databases.values()
        for i, t in enumerate(d.tables)
    ]
    return local_frame(spark, rows, _TABLES)


def denied_frame(spark: SparkSession, registry: Registry) -> DataFrame:
    rows = [(d.name, t) for d in registry.databases.values() for t in sorted(d.denied_tables)]
    return local_frame(spark, rows, "database string, name string")


def visible_frame(catalog: DataFrame, denied: DataFrame) -> DataFrame:
    """Tables neither flagged hidden nor on the deny list."""
    return catalog.filter(~F.col("hidden")).join(denied, ["database", "name"], "left_anti")


def list_databases(spark: SparkSession, registry: Registry) -> DataFrame:
    visible = visible_frame(catalog_frame(spark, registry), denied_frame(spark, registry))
    counted = visible.groupBy(F.col("database").alias("name")).agg(
        F.count("*").alias("table_count")
    )
    return (
        databases_frame(spark, registry)
        .join(counted, "name", "left")
        .select(
            "name",
            "description",
            F.coalesce("table_count", F.lit(0)).alias("table_count"),
            "license",
            "license_url",
        )
    )


def row_counts(registry: Registry, database: str, open_table: Opener) -> DataFrame:
    """(name, row_count) per visible table; no column is read for a bare count."""
    parts = [(spec.name, open_table(database, spec)) for spec in registry.visible_tables(database)]
    return labelled_counts(parts, "name", "row_count")


def described(upstream: Column, fallback: Column) -> Column:
    """Upstream text unless blank, then the configured text, then the empty string."""
    return F.coalesce(F.nullif(upstream, F.lit("")), fallback, F.lit(""))


def list_tables(registry: Registry, database: str, open_table: Opener) -> DataFrame:
    """(name, row_count, description) of the visible tables, in catalog order."""
    specs = registry.visible_tables(database)
    if not specs:
        empty = "name string, row_count long, description string"
        return local_frame(SparkSession.active(), [], empty)
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            described(F.lit(t.upstream_description), F.lit(t.description)).alias("description"),
        )
        for i, t in enumerate(specs)
    ]
    # One entry per registered table, looked up in place.
    texts = F.map_from_arrays(F.array(*[F.lit(t.name) for t in specs]), F.array(*entries))
    listed = row_counts(registry, database, open_table).withColumn("_t", texts[F.col("name")])
    return listed.orderBy("_t.ordinal").select("name", "row_count", "_t.description")


def column_type(dtype: T.DataType) -> str:
    """Storage class name of a Spark type."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    if isinstance(dtype, T.DecimalType):
        return "NUMERIC"
    if isinstance(dtype, T.FractionalType):
        return "REAL"
    if isinstance(dtype, T.BinaryType):
        return "BLOB"
    return "TEXT"


def schema_types(df: DataFrame) -> dict[str, str]:
    return {f.name: column_type(f.dataType) for f in df.schema.fields}


def describe_table(
    spark: SparkSession,
    registry: Registry,
    database: str,
    table: str,
    open_table: Opener,
    upstream_types: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row of eight fields. Types: the frame's own, then configured, then upstream."""
    spec = registry.resolve(database, table)
    df = open_table(database, spec)
    available = registry.visible_columns(spec, df.columns)
    types = {**schema_types(df), **spec.column_types, **(upstream_types or {})}
    columns = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                F.lit(types.get(c, "TEXT")).alias("type"),
                F.lit(spec.column_descriptions.get(c, "")).alias("description"),
            )
            for c in available
        ]
    )
    configured = F.array(*[F.lit(c) for c in spec.light]).cast("array<string>")
    names = F.array(*[F.lit(c) for c in available]).cast("array<string>")
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(table).alias("name"),
        columns.alias("columns"),
        F.array_intersect(configured, names).alias("light_columns"),
        names.alias("available_columns"),
        F.lit(spec.url_column is not None).alias("url_keyed"),
        F.lit(registry.supports_fragments(database, table)).alias("supports_fragments"),
        "row_count",
        described(F.lit(spec.upstream_description), F.lit(spec.description)).alias("description"),
    )


_DESCRIPTION = (
    "database string, name string, columns array<struct<name:string,type:string,description:string>>, "
    "light_columns array<string>, available_columns array<string>, url_keyed boolean, "
    "supports_fragments boolean, description string"
)


def describe_tables(
    spark: SparkSession, registry: Registry, names: Sequence[tuple[str, str]], open_table: Opener
) -> DataFrame:
    """The rows of :func:`describe_table` for many (database, table), with all counts in one job.

    What the registry knows is one local row per table; only the counts read the tables.
    """
    rows, parts = [], []
    for database, table in names:
        spec = registry.resolve(database, table)
        df = open_table(database, spec)
        available = registry.visible_columns(spec, df.columns)
        types = {**schema_types(df), **spec.column_types}
        columns = [
            {"name": c, "type": types.get(c, "TEXT"), "description": spec.column_descriptions.get(c, "")}
            for c in available
        ]
        rows.append((
            database, table, columns, [c for c in dict.fromkeys(spec.light) if c in available], available,
            spec.url_column is not None, registry.supports_fragments(database, table),
            spec.upstream_description or spec.description or "",
        ))
        parts.append((f"{database}.{table}", df))
    counts = labelled_counts(parts, "_label", "row_count")
    known = local_frame(spark, rows, _DESCRIPTION)
    # one row per table
    found = known.join(F.broadcast(counts), F.concat_ws(".", "database", "name") == F.col("_label"))
    return found.select(
        "database", "name", "columns", "light_columns", "available_columns", "url_keyed",
        "supports_fragments", "row_count", "description",
    )
