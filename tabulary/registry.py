"""What is queryable and under which rules: databases, tables, column classes, links."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from tabulary.errors import unknown_database, unknown_table

DEFAULT_CITATION = "{url} (retrieved {retrieved_at})"
MIXED_LICENSE = "mixed"


@dataclass(frozen=True)
class Policy:
    """Terms attached to heavy text wherever it is returned."""

    source: str
    license: str
    license_url: str | None
    redistribution: str = "allowed"


@dataclass(frozen=True)
class FragmentLink:
    """A fragment table hangs off one parent table of the same database."""

    parent_table: str
    parent_fk: str
    parent_pk: str
    order_by: str
    parent_match_order_by: str


@dataclass(frozen=True)
class TableSpec:
    """One table: where it is read from and how its columns are governed.

    ``key`` must identify a row; it is the tiebreak of every ordering. ``derived`` maps
    extra column names to SQL expressions over the stored columns, ``where`` restricts
    the stored rows.
    """

    name: str
    key: tuple[str, ...]
    path: str | None = None
    where: str | None = None
    derived: Mapping[str, str] = field(default_factory=dict)
    hidden: bool = False
    hidden_columns: frozenset[str] = frozenset()
    light: tuple[str, ...] = ()
    url_column: str | None = None
    link: FragmentLink | None = None
    search_columns: tuple[str, ...] = ()
    default_sort: str | None = None
    preview: Mapping[str, str | None] = field(default_factory=dict)
    citation: str | None = None
    policy: Policy | None = None
    description: str = ""
    upstream_description: str = ""
    column_types: Mapping[str, str] = field(default_factory=dict)
    #: If set, the table holds one row per key: the one with the smallest value of this column.
    first_by: str = ""
    column_descriptions: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class DatabaseSpec:
    name: str
    tables: tuple[TableSpec, ...]
    description: str = ""
    license: str = ""
    license_url: str = ""
    upstream_license: str = ""
    upstream_license_url: str = ""
    denied_tables: frozenset[str] = frozenset()

    def license_pair(self) -> tuple[str, str | None]:
        """Upstream pair if either half is set, else the configured pair; blank URL is null."""
        if self.upstream_license or self.upstream_license_url:
            pair = (self.upstream_license, self.upstream_license_url)
        else:
            pair = (self.license, self.license_url)
        return pair[0], pair[1] or None


class Registry:
    """All databases, with the lookups the operators need."""

    def __init__(
        self,
        databases: Iterable[DatabaseSpec],
        *,
        heavy: Iterable[str] = (),
        hidden_columns: Iterable[str] = (),
        source: str = "",
        attribution: str = "",
        search_denied_suffixes: tuple[str, ...] = ("_fragments",),
        secret: bytes | None = None,
    ):
        self.databases = {d.name: d for d in databases}
        # "_policy" lives beside heavy text, so its name is reserved there.
        self.heavy = frozenset(heavy) | {"_policy"}
        self.hidden_columns = frozenset(hidden_columns)
        self.source = source
        self.attribution = attribution
        self.search_denied_suffixes = search_denied_suffixes
        #: Seals hidden keys in positions. Without one given, positions hold for this process only.
        self.secret = secret or os.urandom(32)
        if len(self.secret) not in (16, 24, 32):
            raise ValueError("a secret has 16, 24 or 32 bytes")

    def database(self, name: str) -> DatabaseSpec:
        if name not in self.databases:
            raise unknown_database(name)
        return self.databases[name]

    def is_visible(self, database: str, spec: TableSpec) -> bool:
        return not spec.hidden and spec.name not in self.databases[database].denied_tables

    def visible_tables(self, database: str) -> list[TableSpec]:
        return [t for t in self.database(database).tables if self.is_visible(database, t)]

    def resolve(self, database: str, table: str) -> TableSpec:
        """The table if it is visible; hidden and missing tables fail alike."""
        for spec in self.visible_tables(database):
            if spec.name == table:
                return spec
        raise unknown_table(database, table)

    def any_table(self, database: str, table: str) -> TableSpec:
        """Registry access for internal joins; ignores visibility."""
        for spec in self.database(database).tables:
            if spec.name == table:
                return spec
        raise unknown_table(database, table)

    def hidden_for(self, spec: TableSpec) -> frozenset[str]:
        return self.hidden_columns | spec.hidden_columns

    def visible_columns(self, spec: TableSpec, columns: Iterable[str]) -> list[str]:
        hidden = self.hidden_for(spec)
        return [c for c in columns if c not in hidden]

    def supports_fragments(self, database: str, table: str) -> bool:
        """True on both sides of a parent/fragment pair."""
        tables = self.database(database).tables
        return any(
            t.link is not None and table in (t.name, t.link.parent_table) for t in tables
        )

    def policy_for(self, database: str, spec: TableSpec) -> Policy:
        if spec.policy is not None:
            return spec.policy
        text, url = self.databases[database].license_pair()
        return Policy(source=database, license=text, license_url=url)

    def citation_for(self, spec: TableSpec) -> str:
        return spec.citation or DEFAULT_CITATION
