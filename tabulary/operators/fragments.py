"""Parent-to-fragment joins: a filter on the parent's natural key selects fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulary.functions.urls import normalize_url, url_hash
from tabulary.operators.filters import Clause
from tabulary.operators.numbering import number_rows
from tabulary.operators.sizing import few_rows, hinted
from tabulary.registry import FragmentLink, Registry, TableSpec


def parent_url_column(registry: Registry, database: str, spec: TableSpec) -> str | None:
    """The parent's lookup column, allowed in filters although fragments do not have it."""
    if spec.link is None:
        return None
    return registry.any_table(database, spec.link.parent_table).url_column


def split_trigger(
    registry: Registry, database: str, spec: TableSpec, clauses: Sequence[Clause]
) -> tuple[Clause | None, list[Clause]]:
    """(join clause, remaining clauses). Exactly one ``exact`` on the parent key joins."""
    column = parent_url_column(registry, database, spec)
    exact = [c for c in clauses if c.column == column and c.op == "exact"]
    if column is None or len(exact) != 1:
        return None, list(clauses)
    return exact[0], [c for c in clauses if c is not exact[0]]


def _latest_first(link: FragmentLink, key: Sequence[str]) -> list:
    newest = F.col(link.parent_match_order_by).desc_nulls_last()
    return [newest, *[F.col(k).desc_nulls_last() for k in key]]


def latest_parent(
    parents: DataFrame, lookup: str, link: FragmentLink, key: Sequence[str], value: object
) -> DataFrame:
    """The latest parent carrying ``value``: one row or none."""
    return (
        parents.filter(F.col(lookup) == F.lit(value))
        .orderBy(*_latest_first(link, key))
        .limit(1)
    )


def latest_parents(
    parents: DataFrame, lookup: str, link: FragmentLink, key: Sequence[str]
) -> DataFrame:
    """The latest parent of every lookup value.

    ``row_number() = 1`` plans a group limit before the shuffle, so each task sends one
    row per value however often the value occurs.
    """
    order = Window.partitionBy(lookup).orderBy(*_latest_first(link, key))
    ranked = parents.withColumn("_rank", F.row_number().over(order))
    return ranked.filter("_rank = 1").drop("_rank")


def fragments_of(
    fragments: DataFrame,
    parents: DataFrame,
    lookup: str,
    link: FragmentLink,
    key: Sequence[str],
    value: object,
) -> DataFrame:
    """Fragments of the latest parent carrying ``value``; none for an unknown parent.

    The parent key is a scalar subquery: it runs first and reaches the fragment scan as a
    plain comparison, which Parquet statistics can use.
    """
    chosen = latest_parent(parents, lookup, link, key, value).select(link.parent_pk)
    return fragments.filter(F.col(link.parent_fk) == chosen.scalar())


def _requested(requests: DataFrame, match: str) -> DataFrame:
    if match not in ("raw", "normalized"):
        raise ValueError("match is 'raw' or 'normalized'")
    value = F.col("url") if match == "raw" else normalize_url(F.col("url"))
    return requests.select("url", value.alias("_match")).distinct()


def _matching(parents: DataFrame, lookup: str, match: str) -> DataFrame:
    value = F.col(lookup) if match == "raw" else normalize_url(F.col(lookup))
    return parents.withColumn("_match", value)


def fragments_of_many(
    fragments: DataFrame,
    parents: DataFrame,
    lookup: str,
    link: FragmentLink,
    key: Sequence[str],
    requests: DataFrame,
    match: str = "raw",
) -> DataFrame:
    """Fragments for many parent urls at once: ``parent_url`` plus the fragment columns."""
    wanted = _requested(requests, match)
    # Each url resolves to one parent at most, so the count of urls bounds both joins.
    few = few_rows(wanted)
    candidates = _matching(parents, lookup, match).join(
        hinted(wanted.select("_match").distinct(), few), "_match", "left_semi"
    )
    chosen = latest_parents(candidates, "_match", link, key).select(
        "_match", F.col(link.parent_pk).alias("_pk")
    )
    resolved = wanted.join(chosen, "_match").select(F.col("url").alias("parent_url"), "_pk")
    own = fragments[link.parent_fk] == F.col("_pk")
    return fragments.join(hinted(resolved, few), own).select(
        "parent_url", *[fragments[c] for c in fragments.columns]
    )


def walk(
    fragments: DataFrame,
    parents: DataFrame,
    lookup: str,
    link: FragmentLink,
    parent_key: Sequence[str],
    fragment_key: Sequence[str],
    requests: DataFrame,
    match: str = "raw",
) -> DataFrame:
    """:func:`fragments_of_many` with each fragment's ``position`` under its url."""
    joined = fragments_of_many(fragments, parents, lookup, link, parent_key, requests, match)
    tiebreak = [k for k in fragment_key if k != link.order_by]
    order = [F.col(c).asc_nulls_first() for c in (link.order_by, *tiebreak)]
    return number_rows(joined, order, keys=["parent_url"])


def multi_match_report(parents: DataFrame, lookup: str, link: FragmentLink) -> DataFrame:
    """Lookup values with several parents: how many, which one wins, and a hash as name."""
    counted = parents.groupBy(lookup).agg(
        F.count("*").alias("parent_match_count"),
        F.max(link.parent_match_order_by).alias("selected_parent_match_value"),
    )
    return counted.filter("parent_match_count > 1").select(
        url_hash(normalize_url(F.col(lookup).cast("string"))).alias("parent_url_hash"),
        "parent_match_count",
        "selected_parent_match_value",
    )


def unknown_parents(
    parents: DataFrame, lookup: str, requests: DataFrame, match: str = "raw"
) -> DataFrame:
    """Requested urls without a parent."""
    present = _matching(parents.select(lookup), lookup, match).select("_match").distinct()
    return _requested(requests, match).join(present, "_match", "left_anti").select("url")
