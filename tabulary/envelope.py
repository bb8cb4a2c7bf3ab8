"""Result wrapper: a distributed ``data`` frame with its provenance and page position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame

from tabulary.registry import MIXED_LICENSE, Registry


@dataclass(frozen=True)
class Provenance:
    source: str
    database: str | None
    table: str | None
    retrieved_at: datetime
    license: str
    license_url: str | None
    attribution: str


@dataclass(frozen=True)
class Pagination:
    """``next_position`` names the row to resume after, None on the last page.

    ``total`` counts the matching rows over all pages; it is None unless asked for.
    """

    next_position: tuple | None = None
    truncated: bool = False
    total: int | None = None
    upstream_total_hits: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Envelope:
    """``pagination`` runs a bounded job on first use; ``data`` stays lazy.

    ``at_once`` gives both; where it can, from one job that reads the data once. ``release`` gives
    back what the answer keeps on executors, if it keeps anything.
    """

    data: DataFrame
    provenance: Provenance
    page: Callable[[], Pagination] | None = None
    warnings: tuple[str, ...] = ()
    kept: tuple[DataFrame, ...] = ()
    both: Callable[[], tuple[DataFrame, Pagination]] | None = None

    def at_once(self) -> tuple[DataFrame, Pagination | None]:
        return (self.data, self.pagination()) if self.both is None else self.both()

    def release(self) -> None:
        for frame in self.kept:
            frame.unpersist()

    def pagination(self) -> Pagination | None:
        return None if self.page is None else self.page()


def provenance_for(
    registry: Registry, retrieved_at: datetime, database: str | None = None, table: str | None = None
) -> Provenance:
    """One database carries its own license; answers over several carry ``mixed``."""
    if database is None:
        text, url = MIXED_LICENSE, None
    else:
        text, url = registry.database(database).license_pair()
    return Provenance(
        source=registry.source,
        database=database,
        table=table,
        retrieved_at=retrieved_at,
        license=text,
        license_url=url,
        attribution=registry.attribution,
    )
