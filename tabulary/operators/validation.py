"""Validation as data: a table of requests joined with what may be asked for.

A log of requests, of any size, gets for each request the code that its caller sees. What is known
(databases, tables, columns with their types, keys) is one small row per table; all checks are
expressions over the joined row. Only keys that a fetch names are looked up in the tables themselves.

A request has the columns of :data:`REQUEST`; what a call does not take is ignored. Lists come as JSON
text, as the calls themselves accept them. Null text is an absent argument.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.operators.filters import OPERATORS
from tabulary.operators.fragments import parent_url_column
from tabulary.operators.paging import DEFAULT_LIMIT, DEFAULT_SEARCH_LIMIT, MAX_FRAGMENT_LIMIT, MAX_LIMIT, MAX_SEARCH_LIMIT
from tabulary.operators.search import targets
from tabulary.registry import Registry, TableSpec
from tabulary.session import local_frame

#: Arguments by name; ``call`` is one of the six calls.
REQUEST = (
    "call string, database string, table string, filters string, sort string, limit long, "
    "columns string, position string, query string, databases string, url string"
)
CALLS = ("list_databases", "list_tables", "describe_table", "query_table", "fetch", "search")

_BOUNDS = ("gt", "gte", "lt", "lte")
_LISTS = ("in", "notin")
_FIELDS = ("column", "op", "value")
_WHOLE = r"^\s*[+-]?\d+(_\d+)*\s*$"
_REAL = r"(?i)^\s*[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"

Opener = Callable[[str, TableSpec], DataFrame]


def _family(dtype: T.DataType, declared: str | None) -> str:
    """How a bound on a column of this type is read."""
    if declared in ("INTEGER", "REAL", "TEXT"):
        return declared.lower()
    families = (
        (T.IntegralType, "integer"), ((T.FractionalType, T.DecimalType), "real"), (T.BooleanType, "boolean"),
        (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "timestamp"),
    )
    return next((name for types, name in families if isinstance(dtype, types)), "text")


def known_tables(spark: SparkSession, registry: Registry, open_table: Opener) -> DataFrame:
    """One row per visible table: what requests may name. The registry bounds its size."""
    rows = []
    for database in registry.databases:
        searched = {t.spec.name for t in targets(registry, [database], open_table)}
        for spec in registry.visible_tables(database):
            df = open_table(database, spec)
            hidden = registry.hidden_for(spec)
            families = {
                c: _family(df.schema[c].dataType, spec.column_types.get(c, "").upper())
                for c in registry.visible_columns(spec, df.columns)
            }
            rows.append((
                database, spec.name, families, list(spec.key), [k for k in spec.key if k in hidden],
                spec.url_column is not None, parent_url_column(registry, database, spec),
                spec.link.parent_fk if spec.link else None, spec.link.order_by if spec.link else None,
                spec.name in searched,
            ))
    return local_frame(
        spark, rows,
        "_database string, _table string, _columns map<string,string>, _key array<string>, "
        "_hidden array<string>, _fetchable boolean, _trigger string, _fixed string, _order string, _searched boolean",
    )


def _clauses(text: Column) -> Column:
    """The clauses of a JSON list as structs; null if it is no list, ``fit`` false for a bad shape."""
    items = F.try_parse_json(text).try_cast("array<variant>")

    def clause(item: Column) -> Column:
        fields = item.try_cast("map<string,variant>")
        names = F.map_keys(fields)
        whole = F.array_contains(names, "column") & F.array_contains(names, "op")
        value = F.try_element_at(fields, F.lit("value"))
        op = F.try_element_at(fields, F.lit("op")).try_cast("string")
        return F.struct(
            F.try_element_at(fields, F.lit("column")).try_cast("string").alias("column"),
            op.alias("op"),
            value.try_cast("string").alias("text"),
            F.schema_of_variant(value).alias("kind"),
            value.try_cast("array<variant>").alias("members"),
            F.coalesce(
                whole & (F.size(F.array_except(names, F.array(*map(F.lit, _FIELDS)))) == 0) & op.isin(*OPERATORS),
                F.lit(False),
            ).alias("fit"),
        )

    return F.transform(items, clause)


def _plain_member(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|STRING|BOOLEAN)"), F.lit(False))


def _is_bound(clause: Column, family: Column) -> Column:
    """Whether a value can bound a column of a family; null counts as no."""
    text, kind = clause["text"], clause["kind"]
    scalar = ~kind.rlike("^(ARRAY|OBJECT)")
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    return F.coalesce(
        F.when(family == "integer", (kind == "BIGINT") | ((kind == "STRING") & text.rlike(_WHOLE)))
        .when(family == "real", number | ((kind == "STRING") & text.rlike(_REAL)))
        .when(family == "boolean", scalar & F.lower(text).isin("1", "true", "0", "false"))
        .when(family == "date", scalar & text.try_cast("date").isNotNull())
        .when(family == "timestamp", scalar & text.try_cast("timestamp").isNotNull())
        .otherwise(F.lit(True)),
        F.lit(False),
    )


def _value_fits(clause: Column, columns: Column) -> Column:
    absent = clause["kind"].isNull() | (clause["kind"] == "VOID")
    listed = F.coalesce(F.forall(clause["members"], _plain_member), F.lit(False))
    return (
        F.when(clause["op"].isin("isnull", "notnull"), True)
        .when(absent, False)
        .when(clause["op"].isin(*_LISTS), listed)
        .when(clause["op"].isin(*_BOUNDS), _is_bound(clause, F.try_element_at(columns, clause["column"])))
        .otherwise(True)
    )


def _names(text: Column) -> Column:
    """The names of a JSON list; other text is one name that nothing has, and absent text none."""
    unreadable = F.array(F.lit(None).cast("string"))
    return F.when(F.length(text) > 0, F.coalesce(F.from_json(text, "array<string>"), unreadable)).otherwise(
        F.array().cast("array<string>")
    )


def _within(limit: Column, default: int, most: int | Column) -> Column:
    return F.coalesce(limit, F.lit(default)).between(F.lit(1), F.lit(most) if isinstance(most, int) else most)


def _all_known(names: Column, columns: Column) -> Column:
    """Whether every name is a visible column; a null name is none."""
    return F.forall(names, lambda n: F.coalesce(F.map_contains_key(columns, F.coalesce(n, F.lit(""))), F.lit(False)))


def _query_code() -> Column:
    """Of a page request whose table is known, in the order in which a call checks."""
    clauses, columns, sort = F.col("_clauses"), F.col("_columns"), F.col("sort")
    joins = F.filter(clauses, lambda c: (c["op"] == "exact") & (c["column"] == F.col("_trigger")))
    joined = F.coalesce(F.size(joins) == 1, F.lit(False))
    rest = F.filter(clauses, lambda c: ~(joined & F.coalesce((c["op"] == "exact") & (c["column"] == F.col("_trigger")), F.lit(False))))
    named = F.concat(
        F.transform(rest, lambda c: c["column"]),
        F.when(F.length(sort) > 0, F.array(F.ltrim(sort, F.lit("-")))).otherwise(F.array().cast("array<string>")),
        _names(F.col("columns")),
    )
    ordered = F.when(F.length(sort) > 0, F.ltrim(sort, F.lit("-"))).when(joined, F.col("_order"))
    key = F.when(joined, F.array_remove(F.col("_key"), F.col("_fixed"))).otherwise(F.col("_key"))
    sorted_by = F.when(ordered.isNull(), key).otherwise(F.concat(F.array(ordered), F.array_remove(key, ordered)))
    sealed = F.size(F.array_intersect(sorted_by, F.col("_hidden")))
    arity = F.size(sorted_by) - sealed + F.least(sealed, F.lit(1))
    given = F.size(F.try_parse_json(F.col("position")).try_cast("array<variant>"))
    most = F.when(joined, MAX_FRAGMENT_LIMIT).otherwise(MAX_LIMIT)
    return (
        F.when(~_all_known(named, columns), "unknown_column")
        .when(~_within(F.col("limit"), DEFAULT_LIMIT, most), "invalid_filter_op")
        .when(~F.forall(rest, lambda c: _value_fits(c, columns)), "invalid_filter_op")
        .when(F.col("position").isNotNull() & ~F.coalesce(given == arity, F.lit(False)), "invalid_cursor")
        .otherwise("ok")
    )


def request_codes(requests: DataFrame, registry: Registry, open_table: Opener) -> DataFrame:
    """``requests`` with ``code`` (``ok`` or an error code) and, for a search, ``searched`` tables.

    Hidden and missing names get the same code. A search over databases without a searchable table
    is fine and searches 0 tables. Values stand in no column but their own.
    """
    spark = requests.sparkSession
    known = known_tables(spark, registry, open_table)
    names = sorted(registry.databases)
    given = list(requests.columns)
    here = (F.col("database") == F.col("_database")) & (F.col("table") == F.col("_table"))
    # the known tables are as many as the registry's
    rows = requests.join(F.broadcast(known), here, "left").withColumn(
        "_clauses", _clauses(F.coalesce("filters", F.lit("[]")))
    )
    is_database = F.col("database").isin(names)
    no_table = F.when(~F.coalesce(is_database, F.lit(False)), "unknown_database").when(F.col("_table").isNull(), "unknown_table")
    asked = _names(F.col("databases"))
    asked = F.when(F.size(asked) > 0, asked).otherwise(F.array(*map(F.lit, names)))
    shaped = F.coalesce(F.forall("_clauses", lambda c: c["fit"]), F.lit(False))
    phrase = F.length(F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)^\s+|\s+$", "")) > 0
    code = (
        F.when(F.col("call") == "list_databases", "ok")
        .when(F.col("call") == "list_tables", F.when(F.coalesce(is_database, F.lit(False)), "ok").otherwise("unknown_database"))
        .when(F.col("call") == "describe_table", F.coalesce(no_table, F.lit("ok")))
        .when(
            F.col("call") == "query_table",
            F.when(~_within(F.col("limit"), DEFAULT_LIMIT, MAX_LIMIT) | ~shaped, "invalid_filter_op")
            .otherwise(F.coalesce(no_table, _query_code())),
        )
        .when(
            F.col("call") == "fetch",
            F.coalesce(no_table, F.when(~F.col("_fetchable"), "unsupported_table_for_fetch"), F.lit("ok")),
        )
        .when(
            F.col("call") == "search",
            F.when(~phrase | ~_within(F.col("limit"), DEFAULT_SEARCH_LIMIT, MAX_SEARCH_LIMIT), "invalid_query")
            .when(~F.forall(asked, lambda d: F.coalesce(d.isin(names), F.lit(False))), "unknown_database")
            .otherwise("ok"),
        )
    )
    per_database = {d: 0 for d in names} | {r["_database"]: r["n"] for r in known.filter("_searched").groupBy("_database").agg(F.count("*").alias("n")).collect()}
    counts = F.create_map(*[F.lit(x) for pair in per_database.items() for x in pair])
    searched = F.aggregate(
        F.transform(F.array_distinct(asked), lambda d: F.try_element_at(counts, d).cast("long")),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    checked = rows.withColumn("code", code).withColumn(
        "searched", F.when((F.col("call") == "search") & (F.col("code") == "ok"), searched)
    ).select(*given, "code", "searched")
    return _not_found(checked, registry, open_table)


def _not_found(checked: DataFrame, registry: Registry, open_table: Opener) -> DataFrame:
    """Fetches of a key that no row has; keys are looked up by a join, compared as text."""
    keys = [
        open_table(d, spec).select(
            F.lit(d).alias("_in"), F.lit(spec.name).alias("_of"), F.col(spec.url_column).cast("string").alias("_url")
        ).distinct()
        for d in registry.databases for spec in registry.visible_tables(d) if spec.url_column is not None
    ]
    if not keys:
        return checked
    there = reduce(DataFrame.unionByName, keys)
    # other requests have no key to look up, so they meet nothing and, as nulls, no hot key
    fetched = (F.col("call") == "fetch") & (F.col("code") == "ok")
    wanted = F.when(fetched, F.coalesce("url", F.lit("")))
    same = (wanted == F.col("_url")) & (F.col("database") == F.col("_in")) & (F.col("table") == F.col("_of"))
    found = checked.join(there, same, "left")
    code = F.when(fetched & F.col("_url").isNull(), "not_found").otherwise(F.col("code"))
    return found.withColumn("code", code).select(*checked.columns)
