"""The thirteen filter operators, typed against the column they apply to."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.errors import invalid_filter
from tabulary.functions.text import contains_folded, fold_ascii, fold_ascii_value
from tabulary.session import local_frame

# The filter vocabulary.
OPERATORS = (
    "exact",
    "not",
    "contains",
    "startswith",
    "endswith",
    "gt",
    "gte",
    "lt",
    "lte",
    "in",
    "notin",
    "isnull",
    "notnull",
)
_FIELDS = {"column", "op", "value"}

_NOT_COERCIBLE = "the column's type cannot hold the value as a bound"
_NOT_A_LIST = "membership takes a list of strings and numbers"

#: Membership lists up to this length become a pushed-down IN; longer ones a semi or anti join.
#: Both compare in the same widened type, so the length decides the plan and not the answer.
IN_LIST_LIMIT = 1000


@dataclass(frozen=True)
class Clause:
    """One condition; a request's clauses are all required to hold."""

    column: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise invalid_filter("filter operator not in supported set")

    @staticmethod
    def of(raw: Clause | dict) -> Clause:
        if isinstance(raw, Clause):
            return raw
        if not isinstance(raw, dict) or not {"column", "op"} <= raw.keys() <= _FIELDS:
            raise invalid_filter("clause fields are column, op and value")
        return Clause(raw["column"], raw["op"], raw.get("value"))


class _Unmatchable:
    """A value the column's type cannot hold: equal to nothing."""


def _as_stored(value: Any, dtype: T.DataType) -> Any:
    """The typed form of a value for equality and membership, from its text."""
    text = str(value)
    try:
        if isinstance(dtype, T.IntegralType):
            try:
                whole = int(text)
            except ValueError:
                number = float(text)
                if not number.is_integer():
                    return _Unmatchable
                whole = int(number)
            return whole if -(1 << 63) <= whole < 1 << 63 else _Unmatchable
        if isinstance(dtype, (T.FractionalType, T.DecimalType)):
            return float(text)
        if isinstance(dtype, T.BooleanType):
            return {"1": True, "true": True, "0": False, "false": False}[text.lower()]
        if isinstance(dtype, T.DateType):
            return date.fromisoformat(text)
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return datetime.fromisoformat(text)
    except (ValueError, KeyError, OverflowError):
        return _Unmatchable
    return text


def _as_bound(value: Any, dtype: T.DataType) -> Any:
    """The typed form of a range bound; a bound that does not fit the type is an error."""
    if isinstance(dtype, T.IntegralType):
        # Truncating 3.99 to 3 would silently widen the range, so only whole inputs pass.
        if isinstance(value, (bool, float)):
            raise invalid_filter(_NOT_COERCIBLE)
        try:
            return int(value)
        except (TypeError, ValueError):
            raise invalid_filter(_NOT_COERCIBLE) from None
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        try:
            return float(value)
        except (TypeError, ValueError):
            raise invalid_filter(_NOT_COERCIBLE) from None
    typed = _as_stored(value, dtype)
    if typed is _Unmatchable:
        raise invalid_filter(_NOT_COERCIBLE)
    return typed


def _literal(value: Any, dtype: T.DataType) -> Column:
    # Widening the literal to double or long keeps the column bare, so scans can use it.
    if isinstance(dtype, (T.FractionalType, T.IntegralType, T.StringType, T.BooleanType)):
        return F.lit(value)
    return F.lit(value).cast(dtype)


def _widened(dtype: T.DataType) -> T.DataType:
    """The type in which equality and membership are decided."""
    if isinstance(dtype, T.IntegralType):
        return T.LongType()
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(dtype, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return dtype
    return T.StringType()


def _never(col: Column) -> Column:
    """False for every value, null for null."""
    return F.when(col.isNotNull(), F.lit(False))


def _exact(col: Column, value: Any, dtype: T.DataType) -> Column:
    typed = _as_stored(value, dtype)
    return _never(col) if typed is _Unmatchable else col == _literal(typed, dtype)


_RANGE: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
_LIKE: dict[str, Callable[[Column, str], Column]] = {
    "contains": lambda c, v: c.contains(v),
    "startswith": lambda c, v: c.startswith(v),
    "endswith": lambda c, v: c.endswith(v),
}
# Only as much text is folded as the value is long.
_FOLDED: dict[str, Callable[[Column, str], Column]] = {
    "contains": contains_folded,
    "startswith": lambda c, v: fold_ascii(F.left(c, F.lit(len(v)))) == v,
    "endswith": lambda c, v: fold_ascii(F.right(c, F.lit(len(v)))) == v,
}


def _prefix_range(col: Column, prefix: str) -> Column:
    """Bounds that any spelling of the prefix lies in: upper case sorts below lower case.

    Folded text hides the column from scans; these bare comparisons do not.
    """
    low, high = prefix.upper(), prefix[:-1] + chr(ord(prefix[-1]) + 1)
    return (col >= F.lit(low)) & (col < F.lit(high))


def _like(op: str, col: Column, value: str, dtype: T.DataType) -> Column:
    """Case-insensitive for ASCII letters; the value is literal text, not a pattern."""
    text = col if isinstance(dtype, T.StringType) else col.cast("string")
    if not any(ch in string.ascii_letters for ch in value):
        return _LIKE[op](text, value)
    folded = fold_ascii_value(value)
    found = _FOLDED[op](text, folded)
    if op == "startswith" and isinstance(dtype, T.StringType) and folded.isascii():
        return _prefix_range(col, folded) & found
    return found


def _members(clause: Clause) -> list:
    if not isinstance(clause.value, list) or not all(
        isinstance(v, (str, int, float)) for v in clause.value
    ):
        raise invalid_filter(_NOT_A_LIST)
    return clause.value


def _stored_members(clause: Clause, dtype: T.DataType) -> list:
    typed = (_as_stored(v, dtype) for v in _members(clause))
    return [v for v in dict.fromkeys(typed) if v is not _Unmatchable]


#: Declared types by name, and the types in which such columns compare.
_DECLARED = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType()}


def _compared(df: DataFrame, column: str, declared: Mapping[str, str]) -> tuple[Column, T.DataType]:
    """The column and type a clause compares: a declared type wins over the stored one.

    A column stored in a type of the declared family stays bare.
    """
    stored = df.schema[column].dataType
    wanted = _DECLARED.get(declared.get(column, "").upper())
    if wanted is None or _widened(stored) == wanted:
        return F.col(column), stored
    return F.col(column).try_cast(wanted), wanted


def predicate(clause: Clause, dtype: T.DataType, col: Column | None = None) -> Column:
    """The clause as one boolean Column over a column of type ``dtype``."""
    col = F.col(clause.column) if col is None else col
    if clause.op == "isnull":
        return col.isNull()
    if clause.op == "notnull":
        return col.isNotNull()
    if clause.value is None:
        raise invalid_filter("value required for this operator")
    if clause.op in ("in", "notin"):
        members = [_literal(v, dtype) for v in _stored_members(clause, dtype)]
        wide = col.cast("double") if isinstance(dtype, T.DecimalType) else col
        found = wide.isin(members) if members else _never(col)
        return found if clause.op == "in" else ~found
    if clause.op in _RANGE:
        return _RANGE[clause.op](col, _literal(_as_bound(clause.value, dtype), dtype))
    if clause.op in _LIKE:
        return _like(clause.op, col, str(clause.value), dtype)
    found = _exact(col, clause.value, dtype)
    return found if clause.op == "exact" else ~found


def _is_long_list(clause: Clause) -> bool:
    return clause.op in ("in", "notin") and len(_members(clause)) > IN_LIST_LIMIT


def _join_members(df: DataFrame, clause: Clause, declared: Mapping[str, str]) -> DataFrame:
    """Membership in a long list: a semi join, or an anti join over non-null rows."""
    col, dtype = _compared(df, clause.column, declared)
    wide = _widened(dtype)
    rows = [(v,) for v in _stored_members(clause, dtype)]
    members = local_frame(
        df.sparkSession, rows, T.StructType([T.StructField("_member", wide)])
    )
    same = col.cast(wide) == F.col("_member")
    if clause.op == "in":
        return df.join(members, same, "left_semi")
    return df.filter(col.isNotNull()).join(members, same, "left_anti")


def apply_filters(
    df: DataFrame, clauses: Iterable[Clause | dict], declared: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows for which every clause holds. Clauses may repeat a column.

    ``declared`` names types (INTEGER, REAL, TEXT) that columns are meant to have; values that
    a column stored otherwise cannot give in its declared type are null.
    """
    declared = declared or {}
    parsed = [Clause.of(c) for c in clauses]
    short = [c for c in parsed if c.value is None or not _is_long_list(c)]
    compared = {c.column: _compared(df, c.column, declared) for c in parsed}
    tests = [predicate(c, compared[c.column][1], compared[c.column][0]) for c in short]
    if tests:
        df = df.filter(reduce(and_, tests))
    for clause in parsed:
        if clause not in short:
            df = _join_members(df, clause, declared)
    return df
