"""The query desk: six read-only calls over a registry, each returning an envelope."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.envelope import Envelope, Pagination, provenance_for
from tabulary.errors import not_found, unknown_column
from tabulary.functions.json_args import decode_list
from tabulary.operators import discovery, fragments, lookup, paging, projection, search
from tabulary.operators.filters import Clause, apply_filters
from tabulary.operators.paging import DEFAULT_LIMIT, DEFAULT_SEARCH_LIMIT
from tabulary.registry import Registry, TableSpec
from tabulary.sources.tables import opener


class QueryDesk:
    """Calls validate on the driver, build one plan, and leave its execution to Spark.

    ``clock`` gives the retrieval time, read once per call and stamped on every row.
    """

    def __init__(
        self,
        spark: SparkSession,
        registry: Registry,
        base: str | None = None,
        open_table: Callable[[str, TableSpec], DataFrame] | None = None,
        clock: Callable[[], datetime] = lambda: datetime.now(UTC),
    ):
        if (base is None) == (open_table is None):
            raise ValueError("give either a base folder or an open_table function")
        self.spark = spark
        self.registry = registry
        self.open = open_table or opener(spark, base)
        self.clock = clock

    def list_databases(self) -> Envelope:
        data = discovery.list_databases(self.spark, self.registry)
        return Envelope(data, provenance_for(self.registry, self.clock()))

    def list_tables(self, database: str) -> Envelope:
        data = discovery.list_tables(self.registry, database, self.open)
        return Envelope(data, provenance_for(self.registry, self.clock(), database))

    def describe_table(
        self, database: str, table: str, upstream_types: dict[str, str] | None = None
    ) -> Envelope:
        data = discovery.describe_table(
            self.spark, self.registry, database, table, self.open, upstream_types
        )
        return Envelope(data, provenance_for(self.registry, self.clock(), database, table))

    def query_table(
        self,
        database: str,
        table: str,
        filters: Sequence[Clause | dict] | str | None = None,
        sort: str | None = None,
        limit: int = DEFAULT_LIMIT,
        columns: Sequence[str] | str | None = None,
        position: Sequence[Any] | None = None,
        with_total: bool = False,
        column_types: Mapping[str, str] | None = None,
    ) -> Envelope:
        """One page of rows. ``position`` is the previous page's ``next_position``.

        A position never holds a hidden value: hidden keys are in it sealed by the registry's secret,
        and one of another table or order is refused. ``with_total`` counts all matching
        rows for the pagination. ``column_types`` are stored declarations (see
        ``sources.column_types``) that decide how filter values compare, over the table's own.
        """
        paging.check_limit(limit, paging.MAX_LIMIT)
        clauses = [Clause.of(c) for c in decode_list(filters) or []]
        columns = decode_list(columns)
        spec = self.registry.resolve(database, table)
        df = self.open(database, spec)
        join_column = fragments.parent_url_column(self.registry, database, spec)
        named = [c.column for c in clauses if c.column != join_column]
        wanted = [*named, *([sort.lstrip("-")] if sort else []), *(columns or [])]
        projection.check_columns(self.registry, database, spec, df, wanted)

        trigger, rest = fragments.split_trigger(self.registry, database, spec, clauses)
        if trigger is not None:
            paging.check_limit(limit, paging.MAX_FRAGMENT_LIMIT)
            df = self._fragments_of(database, spec, df, trigger.value)
            sort = sort or spec.link.order_by
        for clause in rest:
            if clause.column not in df.columns:
                raise unknown_column(database, table, clause.column)
        declared = {**spec.column_types, **(column_types or {})}
        rows = apply_filters(df, rest, declared)

        at = self.clock()
        # Under one parent its key is the same on every row, and it must not be shown.
        fixed = {spec.link.parent_fk} if trigger is not None else set()
        keys = paging.sort_keys(sort, [k for k in spec.key if k not in fixed])
        out = projection.enrich(self.registry, database, spec, df, columns, at)
        _, heavy = projection.split_columns(self.registry, spec, df, columns)

        hidden = self.registry.hidden_for(spec)
        asked = "/".join([database, table, sort or "", "parent" if trigger is not None else "all"])
        seal = paging.Seal(self.registry.secret, asked)
        if position is not None:
            position = paging.unsealed(rows, keys, hidden, seal, position)

        def page_position() -> Pagination:
            end, more = paging.sealed_page_end(rows, keys, hidden, limit, seal, position)
            return Pagination(end, more, rows.count() if with_total else None)

        read = {c.column for c in rest}
        if heavy and trigger is None and not read & self.registry.heavy:
            data = paging.late_page(rows, keys, spec.key, limit, position).select(*out)
        else:
            data = paging.page(rows, keys, limit, position).select(*out)
        return Envelope(
            data, provenance_for(self.registry, at, database, table), page=page_position
        )

    def count_rows(
        self, database: str, table: str, filters: Sequence[Clause | dict] | str | None = None
    ) -> int:
        """Rows that match the filters, over all pages."""
        clauses = [Clause.of(c) for c in decode_list(filters) or []]
        spec = self.registry.resolve(database, table)
        df = self.open(database, spec)
        projection.check_columns(
            self.registry, database, spec, df, [c.column for c in clauses]
        )
        return apply_filters(df, clauses, spec.column_types).count()

    def _parent(self, database: str, spec: TableSpec) -> tuple[TableSpec, DataFrame]:
        parent = self.registry.any_table(database, spec.link.parent_table)
        return parent, self.open(database, parent)

    def _fragments_of(
        self, database: str, spec: TableSpec, df: DataFrame, value: Any
    ) -> DataFrame:
        parent, parents = self._parent(database, spec)
        return fragments.fragments_of(
            df, parents, parent.url_column, spec.link, parent.key, value
        )

    def fetch(self, database: str, table: str, url: Any) -> Envelope:
        """The row whose natural key equals ``url`` exactly; a second match is a warning."""
        spec = self.registry.resolve(database, table)
        column = lookup.url_key(database, spec)
        df = self.open(database, spec)
        at = self.clock()
        names = projection.fetch_columns(self.registry, spec, df)
        cite = projection.row_citation(self.registry, spec, df, at)
        found = lookup.find(df, column, spec.key, url).select(*names, cite)
        rows = found.collect()  # two rows at most
        if not rows:
            raise not_found(database, table)
        warnings = ("ambiguous_url: match_count=2",) if len(rows) > 1 else ()
        data = self.spark.createDataFrame(rows[:1], found.schema)
        provenance = provenance_for(self.registry, at, database, table)
        return Envelope(data, provenance, warnings=warnings)

    def fetch_many(
        self, database: str, table: str, urls: DataFrame, match: str = "raw"
    ) -> Envelope:
        """Bulk form: one row per url with its ``match_count``, zero for misses."""
        spec = self.registry.resolve(database, table)
        column = lookup.url_key(database, spec)
        df = self.open(database, spec)
        at = self.clock()
        names = projection.fetch_columns(self.registry, spec, df)
        cited = df.withColumn(
            projection.CITATION, projection.row_citation(self.registry, spec, df, at)
        )
        # The requested key is a column of its own, so a table column "url" is renamed.
        clash = {c: f"row_{c}" for c in names if c in ("url", "match_count")}
        cited = cited.select("*", *[F.col(c).alias(n) for c, n in clash.items()])
        out = [clash.get(c, c) for c in names] + [projection.CITATION]
        data = lookup.fetch_many(cited, column, spec.key, out, urls, match)
        return Envelope(data, provenance_for(self.registry, at, database, table))

    def search(
        self,
        query: str,
        databases: Sequence[str] | str | None = None,
        limit: int = DEFAULT_SEARCH_LIMIT,
        keep_hits: bool = False,
    ) -> Envelope:
        """Merged previews over all searchable tables; totals come with the pagination.

        ``data`` and ``pagination`` each read the searched text when they are used; ``at_once`` gives
        rows and totals from one job that reads it once. With ``keep_hits`` the matches are kept on
        disk, without their text, until the answer's ``release``, for use in several jobs.
        """
        names = search.check_search(self.registry, query, decode_list(databases), limit)
        at = self.clock()
        targets = search.targets(self.registry, names, self.open)
        provenance = provenance_for(self.registry, at)
        if not targets:
            return Envelope(search.empty_rows(self.spark), provenance, page=Pagination)
        tables = [(t, self.open(t.database, t.spec)) for t in targets]
        found = search.find_hits(self.registry, tables, query, keep_hits)
        data = search.search_rows(self.registry, found, limit, at)

        def totals() -> Pagination:
            per_table = search.search_totals(found).collect()  # one row per table
            return Pagination(upstream_total_hits={r["table"]: r["hits"] for r in per_table})

        def at_once() -> tuple[DataFrame, Pagination]:
            rows, per_table = search.rows_and_totals(self.registry, found, limit, at)
            return rows, Pagination(upstream_total_hits=per_table)

        kept = tuple(matched for _, matched in found) if keep_hits else ()
        return Envelope(data, provenance, page=totals, kept=kept, both=at_once)
