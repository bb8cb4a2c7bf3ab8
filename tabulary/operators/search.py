"""Phrase search over many tables: discovery, preview rows, totals and merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabulary.errors import invalid_query
from tabulary.functions.text import matches_phrase_in_any
from tabulary.operators.counts import labelled_counts
from tabulary.operators.merge import round_robin
from tabulary.operators.paging import MAX_SEARCH_LIMIT, SortKey, order_by, sort_keys
from tabulary.operators.projection import row_citation, template_columns
from tabulary.registry import Registry, TableSpec
from tabulary.session import local_frame

# For each preview field the column names tried, in order of preference.
PREVIEW_CANDIDATES = {
    "title": ("title", "case_name", "name", "heading"),
    "date": ("decision_date", "published_date", "pub_date", "date"),
    "summary": ("summary", "description", "abstract", "section"),
    "url": ("source_url", "decision_url", "source_link", "link", "item_url", "url", "permalink"),
}
# The columns of a search row.
PREVIEW_SCHEMA = (
    "title string, date string, summary string, url string, database string, "
    "table string, license string, license_url string, _citation string"
)

Opener = Callable[[str, TableSpec], DataFrame]


@dataclass(frozen=True)
class Target:
    """One table to search; ``turn`` is its place in the round robin."""

    database: str
    spec: TableSpec
    preview: dict[str, str | None]
    turn: int

    @property
    def label(self) -> str:
        return f"{self.database}.{self.spec.name}"


def resolve_preview(
    available: Sequence[str],
    heavy: frozenset[str],
    overrides: dict[str, str | None] | None = None,
    candidates: dict[str, tuple[str, ...]] = PREVIEW_CANDIDATES,
) -> dict[str, str | None] | None:
    """Column per preview field, or None if title or url has no column.

    An override is taken as given, including an explicit None; heavy columns never serve.
    """
    chosen: dict[str, str | None] = {}
    for name, options in candidates.items():
        usable = (c for c in options if c in available and c not in heavy)
        forced = overrides is not None and name in overrides
        chosen[name] = overrides[name] if forced else next(usable, None)
    return None if chosen["title"] is None or chosen["url"] is None else chosen


def _whole(limit: object) -> bool:
    return isinstance(limit, int) and not isinstance(limit, bool)


def check_search(registry: Registry, query: str, databases: Sequence[str] | None, limit: int):
    """Reject blank queries and bad limits; None or [] means every database."""
    if not query.strip() or not _whole(limit) or not 1 <= limit <= MAX_SEARCH_LIMIT:
        raise invalid_query()
    names = list(databases) if databases else list(registry.databases)
    for name in names:
        registry.database(name)
    return sorted(dict.fromkeys(names))


def targets(registry: Registry, databases: Sequence[str], open_table: Opener) -> list[Target]:
    """Searchable tables: indexed, visible, not denied by name, with a usable preview."""
    found: list[Target] = []
    for database in sorted(databases):
        for spec in registry.visible_tables(database):
            if not spec.search_columns or spec.name.endswith(registry.search_denied_suffixes):
                continue
            visible = registry.visible_columns(spec, open_table(database, spec).columns)
            preview = resolve_preview(visible, registry.heavy, dict(spec.preview))
            if preview is not None:
                found.append(Target(database, spec, preview, len(found)))
    return found


def preview_columns(
    registry: Registry, target: Target, df: DataFrame, retrieved_at: datetime
) -> list[Column]:
    """Exactly nine fields; unmapped ones are null."""
    text, url = registry.databases[target.database].license_pair()
    fields = [
        (F.lit(None) if column is None else F.col(column)).cast("string").alias(name)
        for name, column in target.preview.items()
    ]
    return [
        *fields,
        F.lit(target.database).alias("database"),
        F.lit(target.spec.name).alias("table"),
        F.lit(text).alias("license"),
        F.lit(url).cast("string").alias("license_url"),
        row_citation(registry, target.spec, df, retrieved_at),
    ]


def hits(target: Target, df: DataFrame, query: str) -> DataFrame:
    """All rows of one table that hold the phrase in any of its search columns."""
    columns = [F.col(c) for c in target.spec.search_columns]
    return df.filter(matches_phrase_in_any(columns, query))


def table_order(spec: TableSpec) -> list[SortKey]:
    return sort_keys(spec.default_sort, spec.key)


def find_hits(
    registry: Registry,
    tables: Sequence[tuple[Target, DataFrame]],
    query: str,
    keep: bool = False,
) -> list[tuple[Target, DataFrame]]:
    """The matching rows of every table, without the searched text.

    With ``keep`` they are stored on the executors' disks when first used, so that rows and
    totals together read the text once; the caller unpersists these frames.
    """
    found = []
    for target, df in tables:
        needed = [
            *[c for c in target.preview.values() if c is not None],
            *template_columns(registry.citation_for(target.spec)),
            *[k.column for k in table_order(target.spec)],
        ]
        slim = [c for c in dict.fromkeys(needed) if c in df.columns]
        matched = hits(target, df, query).select(*slim)
        found.append((target, matched.persist(StorageLevel.DISK_ONLY) if keep else matched))
    return found


def top_hits(
    registry: Registry, target: Target, matched: DataFrame, limit: int, retrieved_at: datetime
) -> DataFrame:
    """A table's first ``limit`` hits as preview rows with ``round`` and ``turn``."""
    keys = table_order(target.spec)
    carried = [F.col(k.column).alias(f"_k{i}") for i, k in enumerate(keys)]
    placed = [SortKey(f"_k{i}", k.descending) for i, k in enumerate(keys)]
    first = (
        matched.select(*preview_columns(registry, target, matched, retrieved_at), *carried)
        .orderBy(*order_by(placed))
        .limit(limit)
    )
    # At most ``limit`` rows are left here, already on one task.
    ranked = first.withColumn("round", F.row_number().over(Window.orderBy(*order_by(placed))))
    return ranked.withColumn("turn", F.lit(target.turn)).drop(*[k.column for k in placed])


def empty_rows(spark) -> DataFrame:
    return spark.createDataFrame([], PREVIEW_SCHEMA)


def search_rows(
    registry: Registry,
    found: Sequence[tuple[Target, DataFrame]],
    limit: int,
    retrieved_at: datetime,
) -> DataFrame:
    """Merged preview rows in round-robin order, one plan over all tables.

    Rows are checked against the catalog once more before they are merged.
    """
    parts = [top_hits(registry, t, matched, limit, retrieved_at) for t, matched in found]
    rows = visible_only(registry, reduce(DataFrame.unionByName, parts))
    return round_robin(rows, limit).drop("round", "turn")


def rows_and_totals(
    registry: Registry,
    found: Sequence[tuple[Target, DataFrame]],
    limit: int,
    retrieved_at: datetime,
) -> tuple[DataFrame, dict[str, int]]:
    """The rows of :func:`search_rows`, at most ``limit`` and local now, and all hits per table.

    One job reads the searched text once: the hits are counted as they pass on their way to the
    top rows. A table whose counter cannot be trusted is counted by itself afterwards: adaptive
    execution may drop a part that turns out empty, and its counter with it, and a part of the table
    that is computed again, for a lost executor or a range sort, is counted again.
    """
    seen = [(t, Observation(t.label)) for t, _ in found]
    watched = [(t, _watched(matched, counter)) for (t, matched), (_, counter) in zip(found, seen, strict=True)]
    merged = search_rows(registry, watched, limit, retrieved_at)
    rows = merged.collect()
    totals = {t.label: _counted(counter) for t, counter in seen}
    untold = [(t, matched) for t, matched in found if totals[t.label] is None]
    if untold:
        totals |= {r["table"]: r["hits"] for r in search_totals(untold).collect()}  # one row per table
    return merged.sparkSession.createDataFrame(rows, PREVIEW_SCHEMA), totals


def _watched(matched: DataFrame, counter: Observation) -> DataFrame:
    """Count the hits as they pass, and how often each part of the table did."""
    number = F.col("_number")  # part, and place in it by the lower 33 bits
    return (
        matched.withColumn("_number", F.monotonically_increasing_id())
        .withColumns({"_part": F.shiftright(number, 33), "_first": number.bitwiseAND(F.lit((1 << 33) - 1)) == 0})
        .observe(
            counter,
            F.count(F.lit(1)).alias("hits"),
            F.count_if("_first").alias("passes"),
            F.collect_set("_part").alias("parts"),
        )
        .select(*matched.columns)
    )


def _counted(counter: Observation) -> int | None:
    """What the counter saw, or None if it was not in the plan that ran or saw a part twice."""
    try:
        saw = counter.get
    except Py4JJavaError:  # a row without columns
        return None
    return saw["hits"] if saw and saw["passes"] == len(saw["parts"]) else None


def search_totals(found: Sequence[tuple[Target, DataFrame]]) -> DataFrame:
    """Hits per ``database.table``; tables without a hit count zero."""
    return labelled_counts([(t.label, matched) for t, matched in found], "table", "hits")


def totals_map(totals: DataFrame) -> DataFrame:
    """Totals as one map; one entry per registered table."""
    return totals.agg(
        F.map_from_entries(F.collect_list(F.struct("table", "hits"))).alias("upstream_total_hits")
    )


def visible_only(registry: Registry, rows: DataFrame) -> DataFrame:
    """Keep rows whose (database, table) is visible in the catalog."""
    names = [(d, t.name) for d in registry.databases for t in registry.visible_tables(d)]
    catalog = local_frame(rows.sparkSession, names, "database string, table string")
    return rows.join(F.broadcast(catalog), ["database", "table"], "left_semi").select(*rows.columns)
