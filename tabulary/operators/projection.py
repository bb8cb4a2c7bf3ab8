"""Column classes at work: light and heavy projection, content policy, citation."""

from __future__ import annotations

import string
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.errors import unknown_column
from tabulary.registry import Policy, Registry, TableSpec

CITATION = "_citation"
NEST = "retrieved_content"
POLICY = "_policy"


def check_columns(
    registry: Registry, database: str, spec: TableSpec, df: DataFrame, names: Sequence[str]
) -> None:
    """Unknown and hidden names fail alike, before any plan is built."""
    visible = set(registry.visible_columns(spec, df.columns))
    for name in names:
        if name not in visible:
            raise unknown_column(database, spec.name, name)


def default_light(registry: Registry, spec: TableSpec, df: DataFrame) -> list[str]:
    """Configured light columns that exist and are visible; otherwise all visible, sorted."""
    visible = [c for c in registry.visible_columns(spec, df.columns) if c not in registry.heavy]
    if spec.light:
        return [c for c in spec.light if c in visible]
    return sorted(visible)


def split_columns(
    registry: Registry, spec: TableSpec, df: DataFrame, columns: Sequence[str] | None
) -> tuple[list[str], list[str]]:
    """(light, heavy) in request order; no request means the default light set."""
    if columns is None:
        return default_light(registry, spec, df), []
    light = [c for c in columns if c not in registry.heavy]
    return light, [c for c in columns if c in registry.heavy]


def policy_struct(policy: Policy) -> Column:
    return F.struct(
        F.lit(policy.source).alias("source"),
        F.lit(policy.license).alias("license"),
        F.lit(policy.license_url).cast("string").alias("license_url"),
        F.lit(policy.redistribution).alias("redistribution"),
    )


def heavy_nest(heavy: Sequence[str], policy: Policy) -> Column:
    """Heavy text travels only inside this struct, next to its terms."""
    fields = [F.col(c) for c in heavy]
    return F.struct(*fields, policy_struct(policy).alias(POLICY)).alias(NEST)


def template_columns(template: str) -> list[str]:
    """Column names a citation template refers to."""
    names = [name for _, name, _, _ in string.Formatter().parse(template) if name]
    return [n for n in dict.fromkeys(names) if n != "retrieved_at"]


def citation(template: str, available: Sequence[str], retrieved_at: datetime) -> Column:
    """The template rendered per row; missing columns and nulls render as nothing."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name == "retrieved_at":
            parts.append(F.lit(retrieved_at.isoformat()))
        elif name and name in available:
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts).alias(CITATION) if parts else F.lit("").alias(CITATION)


def row_citation(
    registry: Registry, spec: TableSpec, df: DataFrame, retrieved_at: datetime
) -> Column:
    """Citation over visible columns only, so no template can show a hidden one."""
    visible = registry.visible_columns(spec, df.columns)
    return citation(registry.citation_for(spec), visible, retrieved_at)


def enrich(
    registry: Registry,
    database: str,
    spec: TableSpec,
    df: DataFrame,
    columns: Sequence[str] | None,
    retrieved_at: datetime,
) -> list[Column]:
    """The output columns of a row request: light columns, heavy nest if asked, citation.

    Columns that only the citation needs are read and dropped again by column pruning.
    """
    light, heavy = split_columns(registry, spec, df, columns)
    out = [F.col(c) for c in light]
    if heavy:
        out.append(heavy_nest(heavy, registry.policy_for(database, spec)))
    out.append(row_citation(registry, spec, df, retrieved_at))
    return out


def fetch_columns(registry: Registry, spec: TableSpec, df: DataFrame) -> list[str]:
    """Everything visible that is neither heavy nor the link to a parent, sorted."""
    fk = {spec.link.parent_fk} if spec.link else set()
    visible = set(registry.visible_columns(spec, df.columns))
    return sorted(visible - registry.heavy - fk)


def attach_policies(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Policy per row for frames that mix tables: joined on (database, table).

    ``policies`` has one row per registered table. Rows of unlisted tables keep the
    license already on the row and count as redistributable.
    """
    terms = policies.select(
        "database",
        "table",
        F.col("source").alias("_p_source"),
        F.col("license").alias("_p_license"),
        F.col("license_url").alias("_p_url"),
        F.col("redistribution").alias("_p_redistribution"),
    )
    joined = rows.join(terms, ["database", "table"], "left")
    known = F.col("_p_source").isNotNull()
    return joined.select(
        *rows.columns,
        F.struct(
            F.coalesce("_p_source", "database").alias("source"),
            F.when(known, F.col("_p_license")).otherwise(F.col("license")).alias("license"),
            F.when(known, F.col("_p_url")).otherwise(F.col("license_url")).alias("license_url"),
            F.coalesce("_p_redistribution", F.lit("allowed")).alias("redistribution"),
        ).alias(POLICY),
    )
