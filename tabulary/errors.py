"""The error vocabulary. Messages name identifiers only, never values given by the caller."""

from __future__ import annotations

# The codes a caller can see, in their documented order.
ERROR_CODES = (
    "unknown_database",
    "unknown_table",
    "unknown_column",
    "invalid_filter_op",
    "invalid_cursor",
    "invalid_query",
    "unsupported_table_for_fetch",
    "not_found",
    "query_timeout",
    "rate_limited",
    "upstream_unavailable",
)


class QueryError(Exception):
    """A rejected request. ``code`` is one of :data:`ERROR_CODES`."""

    def __init__(self, code: str, detail: str):
        if code not in ERROR_CODES:
            raise ValueError(f"not an error code: {code}")
        super().__init__(f"{code}: {detail}")
        self.code = code


def unknown_database(database: str) -> QueryError:
    return QueryError("unknown_database", f"Database not found: {database}")


def unknown_table(database: str, table: str) -> QueryError:
    """Same error for hidden and for missing tables, so neither can be told apart."""
    return QueryError("unknown_table", f"Table not found: {database}.{table}")


def unknown_column(database: str, table: str, column: str) -> QueryError:
    """Same error for hidden and for missing columns."""
    return QueryError("unknown_column", f"Column not found: {database}.{table}.{column}")


def invalid_filter(detail: str) -> QueryError:
    return QueryError("invalid_filter_op", detail)


def invalid_query() -> QueryError:
    return QueryError("invalid_query", "the search needs a phrase and a limit within bounds")


def invalid_cursor() -> QueryError:
    return QueryError("invalid_cursor", "the position belongs to another request")


def unsupported_fetch(database: str, table: str) -> QueryError:
    return QueryError("unsupported_table_for_fetch", f"{database}.{table} has no natural key to fetch by")


def not_found(database: str, table: str) -> QueryError:
    return QueryError("not_found", f"{database}.{table} holds no row with this key")
