"""Discovery: databases, tables, columns, stored type definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulary.operators import discovery, validation
from tabulary.operators.counts import labelled_counts
from tabulary.plans.bindings import CC_BY, REGISTRY
from tabulary.plans.catalogue import desk, query, table
from tabulary.sources.column_types import column_types

_VISIBLE = {
    "sales": ("orders", "lineitem", "customer", "part", "supplier", "nation", "region"),
    "corpus": ("documents", "pages", "conversations", "threads", "benchmark"),
    "telemetry": ("events",),
}
_THREADS = "(SELECT DISTINCT ON (conv_id) * FROM conversations ORDER BY conv_id, turn)"


def _relation(name: str) -> str:
    return _THREADS if name == "threads" else name


def _counts_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS database, '{t}' AS name, count(*) AS row_count FROM {_relation(t)}"
        for d, names in _VISIBLE.items()
        for t in names
    )


def _counts(spark, sf) -> DataFrame:
    parts = [
        (f"{d}.{t.name}", table(spark, sf, f"{d}.{t.name}"))
        for d in REGISTRY.databases
        for t in REGISTRY.visible_tables(d)
    ]
    counted = labelled_counts(parts, "label", "row_count")
    names = F.split("label", r"\.")
    return counted.select(names[0].alias("database"), names[1].alias("name"), "row_count")


@query(_counts_sql())
def row_counts(spark, sf):
    return _counts(spark, sf)


@query(
    "SELECT name, description, CAST(table_count AS BIGINT) AS table_count, license, license_url, row_count FROM (VALUES "
    f"('sales', 'Orders, parts and customers.', 7, 'CC-BY-4.0', '{CC_BY}'), "
    "('corpus', 'Documents, pages and dialogues.', 5, 'ODC-BY', "
    "'https://opendatacommons.org/licenses/by/1-0/'), "
    f"('telemetry', 'Service events.', 1, 'CC-BY-4.0', '{CC_BY}')) "
    "d(name, description, table_count, license, license_url) JOIN "
    "(SELECT database, CAST(sum(row_count) AS BIGINT) AS row_count "
    f"FROM ({_counts_sql()}) GROUP BY database) c ON c.database = d.name"
)
def database_list(spark, sf):
    """``list_databases`` with the rows held by each database's visible tables."""
    held = _counts(spark, sf).groupBy(F.col("database").alias("name")).agg(
        F.sum("row_count").alias("row_count")
    )
    return desk(spark, sf).list_databases().data.join(held, "name")


_DESCRIPTIONS = {
    "orders": "Customer orders.",
    "lineitem": "Order lines.",
    "customer": "Customers.",
    "part": "Parts on offer.",
    "documents": "Documents in four languages.",
    "pages": "Raw web pages.",
    "conversations": "Dialogue turns.",
    "threads": "One row per dialogue.",
    "events": "Request log.",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{d}' AS database, '{t}' AS name, count(*) AS row_count, "
        f"'{_DESCRIPTIONS.get(t, '')}' AS description FROM {_relation(t)}"
        for d, names in _VISIBLE.items()
        for t in names
    )
)
def table_list(spark, sf):
    parts = [
        desk(spark, sf).list_tables(d).data.select(
            F.lit(d).alias("database"), "name", "row_count", "description"
        )
        for d in REGISTRY.databases
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    " UNION ALL ".join(
        f"SELECT '{d}' AS database, '{t}' AS name, count(*) AS row_count FROM {_relation(t)}"
        for d, names in _VISIBLE.items()
        for t in names
    )
)
def visible_tables(spark, sf):
    """Every registered table, counted, less the hidden and the denied ones."""
    parts = [
        (f"{d.name}.{t.name}", table(spark, sf, f"{d.name}.{t.name}"))
        for d in REGISTRY.databases.values()
        for t in d.tables
    ]
    counted = labelled_counts(parts, "label", "row_count")
    catalog = discovery.catalog_frame(spark, REGISTRY).withColumn(
        "label", F.concat_ws(".", "database", "name")
    )
    visible = discovery.visible_frame(catalog, discovery.denied_frame(spark, REGISTRY))
    return visible.join(counted, "label").select("database", "name", "row_count")


@query(f"SELECT database, count(*) AS tables FROM ({_counts_sql()}) GROUP BY database")
def visible_table_counts(spark, sf):
    return visible_tables(spark, sf).groupBy("database").agg(F.count("*").alias("tables"))


#: Columns of the described tables: (name, type, in the light set, description).
_DESCRIBED = {
    ("sales", "orders", True, True): (
        ("o_orderkey", "INTEGER", True, ""),
        ("o_custkey", "INTEGER", True, ""),
        ("o_orderstatus", "TEXT", False, ""),
        ("o_totalprice", "REAL", True, "Order value"),
        ("o_orderdate", "TEXT", True, ""),
        ("o_orderpriority", "TEXT", True, ""),
    ),
    ("sales", "lineitem", False, True): (
        ("l_partkey", "INTEGER", True, ""),
        ("l_suppkey", "INTEGER", False, ""),
        ("l_linenumber", "INTEGER", True, ""),
        ("l_quantity", "REAL", True, ""),
        ("l_extendedprice", "REAL", True, ""),
        ("l_discount", "REAL", False, ""),
        ("l_tax", "REAL", False, ""),
        ("l_returnflag", "TEXT", False, ""),
        ("l_linestatus", "TEXT", False, ""),
        ("l_shipdate", "TEXT", True, ""),
    ),
    ("sales", "supplier", False, False): (
        ("s_suppkey", "INTEGER", False, ""),
        ("s_name", "TEXT", False, ""),
        ("s_nationkey", "INTEGER", False, ""),
    ),
    ("corpus", "pages", True, False): (
        ("page_id", "INTEGER", False, ""),
        ("url", "TEXT", False, ""),
        ("html", "TEXT", False, ""),
        ("title", "TEXT", False, ""),
    ),
    ("sales", "customer", False, False): (
        ("c_custkey", "INTEGER", False, ""),
        ("c_name", "TEXT", False, ""),
        ("c_nationkey", "INTEGER", False, ""),
        ("c_acctbal", "REAL", False, ""),
        ("c_mktsegment", "TEXT", False, ""),
    ),
    ("sales", "part", False, False): (
        ("p_partkey", "INTEGER", True, ""),
        ("p_name", "TEXT", True, ""),
        ("p_brand", "TEXT", True, ""),
        ("p_type", "TEXT", True, ""),
        ("p_size", "INTEGER", False, ""),
        ("p_retailprice", "REAL", False, ""),
        ("title", "TEXT", False, ""),
        ("url", "TEXT", False, ""),
    ),
    ("sales", "nation", False, False): (
        ("n_nationkey", "INTEGER", False, ""),
        ("n_name", "TEXT", False, ""),
        ("n_regionkey", "INTEGER", False, ""),
    ),
    ("sales", "region", False, False): (
        ("r_regionkey", "INTEGER", False, ""),
        ("r_name", "TEXT", False, ""),
    ),
    ("corpus", "documents", False, False): (
        ("doc_id", "INTEGER", True, ""),
        ("text", "TEXT", False, ""),
        ("lang", "TEXT", True, ""),
        ("source", "TEXT", True, ""),
        ("n_chars", "INTEGER", True, ""),
        ("title", "TEXT", False, ""),
        ("url", "TEXT", False, ""),
    ),
    ("corpus", "conversations", False, True): (
        ("conv_id", "INTEGER", False, ""),
        ("turn", "INTEGER", True, ""),
        ("role", "TEXT", True, ""),
        ("text", "TEXT", False, ""),
        ("title", "TEXT", False, ""),
        ("url", "TEXT", False, ""),
    ),
    ("corpus", "threads", True, True): (
        ("conv_id", "INTEGER", False, ""),
        ("turn", "INTEGER", False, ""),
        ("role", "TEXT", True, ""),
        ("text", "TEXT", False, ""),
        ("thread_url", "TEXT", True, ""),
    ),
    ("corpus", "benchmark", False, False): (
        ("item_id", "INTEGER", False, ""),
        ("text", "TEXT", False, ""),
        ("title", "TEXT", False, ""),
        ("url", "TEXT", False, ""),
    ),
    ("telemetry", "events", False, False): (
        ("event_id", "INTEGER", True, ""),
        ("ts", "TEXT", True, ""),
        ("user_id", "INTEGER", False, ""),
        ("event_type", "TEXT", True, ""),
        ("value", "REAL", True, ""),
        ("props", "TEXT", False, ""),
    ),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, "
        f"'{text}' AS description, {light} AS light, {keyed} AS url_keyed, "
        f"{frag} AS supports_fragments, (SELECT count(*) FROM {_relation(t)}) AS row_count"
        for (_, t, keyed, frag), columns in _DESCRIBED.items()
        for c, kind, light, text in columns
    )
)
def table_description(spark, sf):
    names = [(database, name) for database, name, _, _ in _DESCRIBED]
    served = desk(spark, sf)
    schema = discovery.describe_tables(spark, served.registry, names, served.open)
    return schema.select(
        F.col("name").alias("table"),
        F.explode("columns").alias("c"),
        "light_columns",
        "url_keyed",
        "supports_fragments",
        "row_count",
    ).select(
        "table",
        F.col("c.name").alias("column"),
        F.col("c.type").alias("type"),
        F.col("c.description").alias("description"),
        F.array_contains("light_columns", F.col("c.name")).alias("light"),
        "url_keyed",
        "supports_fragments",
        "row_count",
    )


@query(
    "SELECT event_id AS \"table\", 'k' AS \"column\", json_extract_string(props, '$.k') AS type "
    "FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type <> 'signup'"
)
def stored_definitions(spark, sf):
    """JSON objects kept in a column, one row per entry; malformed ones yield nothing."""
    events = table(spark, sf, "telemetry.events")
    broken = F.when(F.col("event_type") == "signup", F.lit("{not json")).otherwise(F.col("props"))
    return column_types(events.withColumn("props", broken), "event_id", "props")


#: Rules of request validation: where the offered values stand, the request's call and arguments as
#: SQL over the value v, and its code. Values of one table stand where a request needs something
#: else, or something in bounds.
_CLAUSE = """concat('[{"column": "o_custkey", "op": %s}]')"""
_RULES = {
    "database": ("sales.region", "r_name", {"call": "'list_tables'", "database": "v"}, "'unknown_database'"),
    "table": ("sales.nation", "n_name", {"database": "'sales'", "table": "v"}, "'unknown_table'"),
    "column": (
        "sales.customer", "c_mktsegment",
        {"database": "'sales'", "table": "'orders'", "columns": "to_json(array(v))"}, "'unknown_column'",
    ),
    "sort": ("sales.orders", "o_orderstatus", {"database": "'sales'", "table": "'lineitem'", "sort": "v"}, "'unknown_column'"),
    "operator": (
        "sales.orders", "o_orderpriority",
        {"database": "'sales'", "table": "'orders'", "filters": _CLAUSE % """"', v, '\""""}, "'invalid_filter_op'",
    ),
    "bound": (
        "sales.orders", "o_orderstatus",
        {"database": "'sales'", "table": "'orders'", "filters": _CLAUSE % """"gt", "value": "', v, '\""""}, "'invalid_filter_op'",
    ),
    "list": (
        "telemetry.events", "event_type",
        {"database": "'sales'", "table": "'orders'", "filters": _CLAUSE % """"in", "value": "', v, '\""""}, "'invalid_filter_op'",
    ),
    "limit": (
        "sales.lineitem", "l_linenumber", {"call": "'search'", "query": "'steel'", "limit": "20L * v"},
        "CASE WHEN 20 * l_linenumber <= 100 THEN 'ok' ELSE 'invalid_query' END",
    ),
    "page": (
        "sales.lineitem", "l_linenumber", {"database": "'sales'", "table": "'orders'", "limit": "40L * v"},
        "CASE WHEN 40 * l_linenumber <= 200 THEN 'ok' ELSE 'invalid_filter_op' END",
    ),
    "search": (
        "corpus.documents", "lang", {"call": "'search'", "query": "'x'", "databases": "to_json(array(v))"}, "'unknown_database'",
    ),
    "phrase": ("corpus.documents", "lang", {"call": "'search'", "query": "repeat(' ', length(v))"}, "'invalid_query'"),
    "fetch": (
        "corpus.documents", "lang", {"call": "'fetch'", "database": "'sales'", "table": "'customer'", "url": "v"},
        "'unsupported_table_for_fetch'",
    ),
    "missing": (
        "corpus.documents", "lang", {"call": "'fetch'", "database": "'corpus'", "table": "'pages'", "url": "v"}, "'not_found'",
    ),
}


def _codes(spark, sf, requests):
    served = desk(spark, sf)
    return validation.request_codes(requests, served.registry, served.open)


@query(
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, CAST(v AS VARCHAR) AS value, code FROM (SELECT DISTINCT {column} AS v, "
        f"{code} AS code FROM {name.split('.')[1]} WHERE {column} IS NOT NULL)"
        for rule, (name, column, _, code) in _RULES.items()
    )
)
def validation_codes(spark, sf):
    """The code that each distinct value meets where a request may not have it."""
    offered, arguments = [], T.StructType.fromDDL(validation.REQUEST)
    for rule, (name, column, given, _) in _RULES.items():
        values = table(spark, sf, name).select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
        given = {"call": "'query_table'"} | given
        offered.append(values.select(
            F.lit(rule).alias("rule"), F.col("v").cast("string").alias("value"),
            *[F.expr(given.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in arguments],
        ))
    return _codes(spark, sf, reduce(DataFrame.unionByName, offered)).select("rule", "value", "code")


def _turns(step: int, values: list[str | None]) -> str:
    """SQL: one of the values by turns, changing every ``step`` events."""
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE CAST(floor(event_id / {step}) AS BIGINT) % {len(values)} {arms} END"


def _filter(column: str, op: str, value: str | None = None, more: str = "") -> str:
    value = "" if value is None else f', "value": {value}'
    return f'[{{"column": "{column}", "op": "{op}"{value}{more}}}]'


#: Offered clauses on the order number, and whether they fit where that column may be named.
_OFFERED = {
    _filter("o_custkey", "gt", "5"): True, _filter("o_custkey", "gt", '"12"'): True,
    _filter("o_custkey", "gte", '"abc"'): False, _filter("o_custkey", "lt", "3.99"): False,
    _filter("o_custkey", "lte", "true"): False, _filter("o_custkey", "gt"): False,
    _filter("o_custkey", "gt", "null"): False, _filter("o_custkey", "contains"): False,
    _filter("o_custkey", "isnull"): True, _filter("o_custkey", "notnull", '"x"'): True,
    _filter("o_custkey", "in", "[1, 2.5, \"3\"]"): True, _filter("o_custkey", "notin", "[]"): True,
    _filter("o_custkey", "in", "7"): False, _filter("o_custkey", "in", "[[1]]"): False,
    _filter("o_custkey", "notin", "[1, null]"): False,
}
#: Clauses that no table takes, whatever their column.
_MISSHAPEN = [
    _filter("o_custkey", "regex", '".*"'), _filter("o_custkey", "gt", "5", ', "not": true'),
    '[{"op": "isnull"}]', '["o_custkey"]', "oops",
]
_TABLES = ["orders", "lineitem", "orders", "documents", "labels", "embeddings", "nowhere", "orders"]
_FILTERS = [None, "[]", *_OFFERED, *_MISSHAPEN]
_SORTS = [None, "o_custkey", "-o_totalprice", "l_orderkey", "nothing", "o_orderkey"]
_POSITIONS = [None, None, "[1]", "[1, 2]", "[]", "broken"]
#: The arguments of the request that an event is read as; Spark and the oracle build them alike.
_ASKED = {
    "event_id": "event_id",
    "call": "CASE event_type WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'fetch' WHEN 'signup' THEN 'list_tables' "
    "WHEN 'error' THEN 'describe_table' ELSE 'query_table' END",
    "database": _turns(1, ["sales", "sales", "corpus", "sales", "telemetry", "SALES", "sales", None]),
    "table": _turns(3, _TABLES),
    "filters": _turns(5, _FILTERS),
    "sort": _turns(2, _SORTS),
    "limit": "CASE WHEN event_id % 4 = 3 THEN event_id % 211 ELSE 50 END",
    "columns": _turns(7, [None, None, None, '["o_custkey"]', '["o_custkey", "l_orderkey"]']),
    "position": _turns(11, _POSITIONS),
    "query": _turns(3, ["steel", "data", " ", "", None]),
    "databases": _turns(13, [None, "[]", '["telemetry"]', '["sales", "corpus"]', '["sales", "none"]', "corpus"]),
    "url": "CAST(event_id % 3000 AS VARCHAR(20))",
}
_REQUESTS = "SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in _ASKED.items()) + " FROM events"


def _request_codes_sql() -> str:
    """The same codes from lists of names, written out for the tables that requests name."""
    spec = {t: REGISTRY.any_table(d, t) for d, t in (("sales", "orders"), ("sales", "lineitem"), ("corpus", "documents"))}
    listed = ", ".join
    fit = listed(f"('{f}', {str(ok).lower()})" for f, ok in _OFFERED.items())
    misshapen = listed(f"('{f}')" for f in _MISSHAPEN)
    orders = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    assert spec["orders"].key == ("o_orderkey",) and len(spec["lineitem"].key) == 11
    return f"""
WITH r AS ({_REQUESTS}),
fits AS (SELECT * FROM (VALUES {fit}) t(f, ok)), misshapen AS (SELECT * FROM (VALUES {misshapen}) t(f)),
w AS (
  SELECT r.*, ltrim(sort, '-') AS sorted_by, coalesce("limit" BETWEEN 1 AND 200, true) AS paged,
    filters IN (SELECT f FROM misshapen) AS bad_shape, fits.f IS NOT NULL AS has_filter, coalesce(fits.ok, true) AS fit,
    CASE WHEN database IS NULL OR database NOT IN ('sales', 'corpus', 'telemetry') THEN 'unknown_database'
      WHEN NOT ((database = 'sales' AND "table" IN ('orders', 'lineitem')) OR (database = 'corpus' AND "table" = 'documents'))
      THEN 'unknown_table' END AS no_table,
    CASE WHEN columns LIKE '%l_orderkey%' THEN 2 WHEN columns IS NOT NULL THEN 1 ELSE 0 END AS named
  FROM r LEFT JOIN fits ON r.filters = fits.f
),
c AS (
  SELECT *, CASE
    WHEN NOT paged OR coalesce(bad_shape, false) THEN 'invalid_filter_op'
    WHEN no_table IS NOT NULL THEN no_table
    WHEN "table" <> 'orders' AND (has_filter OR sorted_by IS NOT NULL OR named > 0) THEN 'unknown_column'
    WHEN sorted_by NOT IN ({listed(f"'{c}'" for c in orders)}) OR named = 2 THEN 'unknown_column'
    WHEN NOT fit THEN 'invalid_filter_op'
    WHEN position IS NOT NULL AND (position = 'broken' OR json_array_length(position) <>
      CASE "table" WHEN 'lineitem' THEN 11 WHEN 'documents' THEN 1 ELSE CASE WHEN sorted_by IS NULL OR sorted_by = 'o_orderkey' THEN 1 ELSE 2 END END)
      THEN 'invalid_cursor'
    ELSE 'ok' END AS page_code,
    trim(coalesce(query, '')) <> '' AND "limit" BETWEEN 1 AND 100 AS phrased
  FROM w
)
SELECT event_id, call, CASE call
    WHEN 'list_tables' THEN CASE WHEN no_table = 'unknown_database' THEN no_table ELSE 'ok' END
    WHEN 'describe_table' THEN coalesce(no_table, 'ok')
    WHEN 'query_table' THEN page_code
    WHEN 'fetch' THEN coalesce(no_table, CASE WHEN "table" <> 'orders' THEN 'unsupported_table_for_fetch'
      WHEN url NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders) THEN 'not_found' ELSE 'ok' END)
    ELSE CASE WHEN NOT phrased THEN 'invalid_query' WHEN databases LIKE '%none%' OR databases = 'corpus' THEN 'unknown_database' ELSE 'ok' END
  END AS code,
  CASE WHEN call = 'search' AND phrased AND coalesce(databases NOT LIKE '%none%' AND databases <> 'corpus', true) THEN
    CASE WHEN databases LIKE '%telemetry%' THEN 0 ELSE 5 END END::BIGINT AS searched
FROM c"""


@query(_request_codes_sql())
def request_codes(spark, sf):
    """Every event read as a request: the code its caller sees, and how many tables a search covers."""
    events = table(spark, sf, "telemetry.events")
    requests = events.selectExpr(*[f"{sql} AS `{name}`" for name, sql in _ASKED.items()])
    return _codes(spark, sf, requests).select("event_id", "call", "code", "searched")
