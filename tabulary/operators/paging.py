"""Ordering, limits and keyset continuation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.errors import invalid_cursor, invalid_filter
from tabulary.operators.numbering import number_rows
from tabulary.session import local_frame

# Page size defaults and bounds.
DEFAULT_LIMIT, MAX_LIMIT, MAX_FRAGMENT_LIMIT = 50, 200, 100
DEFAULT_SEARCH_LIMIT, MAX_SEARCH_LIMIT = 20, 100


@dataclass(frozen=True)
class SortKey:
    """Nulls are the lowest values: first ascending, last descending."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        col = F.col(self.column)
        return col.desc_nulls_last() if self.descending else col.asc_nulls_first()

    def equals(self, value: Any) -> Column:
        col = F.col(self.column)
        return col.isNull() if value is None else col == F.lit(value)

    def beyond(self, value: Any) -> Column:
        """Rows strictly after ``value`` in this key's order."""
        col = F.col(self.column)
        if self.descending:
            return F.lit(False) if value is None else (col < F.lit(value)) | col.isNull()
        return col.isNotNull() if value is None else col > F.lit(value)

    def from_on(self, value: Any) -> Column | None:
        """A weaker test on this key alone that a Parquet scan can use to skip row groups."""
        col = F.col(self.column)
        if value is None:
            return col.isNull() if self.descending else None
        if self.descending:
            return (col <= F.lit(value)) | col.isNull()
        return col >= F.lit(value)


def check_limit(limit: int, maximum: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= maximum:
        raise invalid_filter(f"limit must be between 1 and {maximum}")
    return limit


def sort_keys(sort: str | None, key: Sequence[str]) -> list[SortKey]:
    """``-column`` sorts descending; the row key always follows as tiebreak."""
    keys: list[SortKey] = []
    if sort:
        keys.append(SortKey(sort.lstrip("-"), sort.startswith("-")))
    return keys + [SortKey(k) for k in key if not keys or k != keys[0].column]


def order_by(keys: Sequence[SortKey]) -> list[Column]:
    return [k.order() for k in keys]


def after(keys: Sequence[SortKey], position: Sequence[Any]) -> Column:
    """Keyset condition: rows strictly after ``position`` in the order of ``keys``."""
    if len(position) != len(keys):
        raise invalid_cursor()
    steps = []
    for i, key in enumerate(keys):
        same = [k.equals(v) for k, v in zip(keys[:i], position, strict=False)]
        steps.append(reduce(and_, [*same, key.beyond(position[i])]))
    condition = reduce(or_, steps)
    bound = keys[0].from_on(position[0])
    return condition if bound is None else bound & condition


@dataclass(frozen=True)
class Seal:
    """Keeps hidden key values of a position from the caller, by authenticated encryption.

    ``secret`` has 16, 24 or 32 bytes and stays with the service; ``request`` names what the
    position belongs to, so one of another request, or a changed one, cannot be opened. What is
    sealed are the values themselves: the next page needs no look at the table to go on.
    """

    secret: bytes
    request: str

    def _how(self) -> list[Column]:
        return [F.lit("GCM"), F.lit("DEFAULT")]

    def closed(self, columns: Sequence[str]) -> Column:
        """The values of some columns as one text; no two closings look alike."""
        values = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
        no_iv = F.lit(b"")  # one is drawn
        return F.base64(F.aes_encrypt(values, F.lit(self.secret), *self._how(), no_iv, F.lit(self.request)))

    def opened(self, df: DataFrame, columns: Sequence[str], text: Any) -> tuple:
        """The values that ``text`` holds, in the types of the columns; a stranger is an error."""
        if not isinstance(text, str):
            raise invalid_cursor()
        found = F.from_json(
            F.try_aes_decrypt(F.try_to_binary(F.lit(text), F.lit("base64")), F.lit(self.secret), *self._how(), F.lit(self.request))
            .cast("string"),
            "array<string>",
        )
        typed = [F.get(found, F.lit(i)).cast(df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(columns)]
        one = local_frame(df.sparkSession, [(1,)], "one int")
        row = one.select((F.size(found) == len(columns)).alias("known"), *typed).first()
        if not row["known"]:
            raise invalid_cursor()
        return tuple(row)[1:]


def sealed_page_end(
    df: DataFrame,
    keys: Sequence[SortKey],
    hidden: frozenset[str],
    limit: int,
    seal: Seal,
    position: Sequence[Any] | None = None,
) -> tuple[tuple | None, bool]:
    """As :func:`page_end`, but all hidden key values of the row are sealed in one text at the end."""
    kept = [k.column for k in keys if k.column not in hidden]
    inside = [k.column for k in keys if k.column in hidden]
    probe = page(df.select(*[k.column for k in keys]), keys, limit + 1, position)
    shown = [F.col(c) for c in kept] + ([seal.closed(inside).alias("_sealed")] if inside else [])
    rows = probe.select(*shown).collect()  # bounded by the page size
    if len(rows) <= limit:
        return None, False
    return tuple(rows[limit - 1]), True


def unsealed(
    df: DataFrame, keys: Sequence[SortKey], hidden: frozenset[str], seal: Seal, position: Sequence[Any]
) -> tuple:
    """The full position behind a sealed one."""
    kept = [k.column for k in keys if k.column not in hidden]
    inside = [k.column for k in keys if k.column in hidden]
    if not inside:
        return tuple(position)
    if len(position) != len(kept) + 1:
        raise invalid_cursor()
    known = dict(zip(kept, position, strict=False))
    known |= zip(inside, seal.opened(df, inside, position[-1]), strict=True)
    return tuple(known[k.column] for k in keys)


def page(
    df: DataFrame, keys: Sequence[SortKey], limit: int, position: Sequence[Any] | None = None
) -> DataFrame:
    """One page in order: a filter on the key and a top-``limit``, never an offset."""
    if position is not None:
        df = df.filter(after(keys, position))
    return df.orderBy(*order_by(keys)).limit(limit)


def late_page(
    df: DataFrame,
    keys: Sequence[SortKey],
    row_key: Sequence[str],
    limit: int,
    position: Sequence[Any] | None = None,
) -> DataFrame:
    """A page with heavy columns: rows are chosen on their keys, then read in full.

    The first job reads the sort and key columns alone and brings the chosen keys, ``limit`` at
    most, to the driver. As literals they reach the second scan, which skips the row groups
    that hold none of them; where the table is not laid out by its key that may be no group.
    """
    slim = df.select(*dict.fromkeys([*[k.column for k in keys], *row_key]))
    chosen = page(slim, keys, limit, position).select(*row_key).distinct().collect()
    if not chosen:
        return df.limit(0)
    first = [r[0] for r in chosen if r[0] is not None]
    within = F.col(row_key[0]).isin(first)
    if len(first) < len(chosen):
        within = within | F.col(row_key[0]).isNull()
    if len(row_key) > 1:
        rest = [SortKey(k) for k in row_key]
        exact = [reduce(and_, [k.equals(v) for k, v in zip(rest, r, strict=True)]) for r in chosen]
        within = within & reduce(or_, exact)
    return df.filter(within).orderBy(*order_by(keys)).limit(limit)


def page_end(
    df: DataFrame, keys: Sequence[SortKey], limit: int, position: Sequence[Any] | None = None
) -> tuple[tuple | None, bool]:
    """(key of the page's last row, whether rows follow). Reads ``limit`` + 1 keys."""
    probe = page(df.select(*[k.column for k in keys]), keys, limit + 1, position)
    rows = probe.collect()  # bounded by the page size
    if len(rows) <= limit:
        return None, False
    return tuple(rows[limit - 1]), True


def assign_pages(
    df: DataFrame, keys: Sequence[SortKey], size: int, name: str = "page"
) -> DataFrame:
    """The zero-based page of every row: a full walk as one job instead of many requests."""
    numbered = number_rows(df, order_by(keys))
    return numbered.withColumn(name, F.floor((F.col("position") - 1) / size).cast("long"))
