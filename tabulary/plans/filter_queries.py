"""Scans and the filter vocabulary, over whole tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators.filters import apply_filters
from tabulary.plans.catalogue import desk, query, table

#: ASCII-only folding, spelled for the oracle.
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ORDER = ("o_orderkey", "o_custkey", "o_totalprice")


def _where(spark: SparkSession, sf: str, name: str, columns, *clauses) -> DataFrame:
    parsed = [dict(zip(("column", "op", "value"), c, strict=False)) for c in clauses]
    return apply_filters(table(spark, sf, name), parsed).select(*columns)


def _nullable_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "sales.orders")
    return orders.withColumn("status", F.nullif("o_orderstatus", F.lit("P")))


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders "
    "WHERE o_totalprice >= 100000 AND starts_with(o_orderpriority, '1')"
)
def table_scan(spark, sf):
    columns = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    clauses = (("o_totalprice", "gte", 100000), ("o_orderpriority", "startswith", "1"))
    return _where(spark, sf, "sales.orders", columns, *clauses)


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"
)
def filter_exact(spark, sf):
    return _where(spark, sf, "sales.orders", _ORDER, ("o_orderpriority", "exact", "1-URGENT"))


@query(
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders "
    "WHERE nullif(o_orderstatus, 'P') <> 'F'"
)
def filter_not(spark, sf):
    rows = apply_filters(
        _nullable_orders(spark, sf), [{"column": "status", "op": "not", "value": "F"}]
    )
    return rows.select("o_orderkey", "status")


@query(f"SELECT doc_id, n_chars FROM documents WHERE contains({_FOLD.format('text')}, 'é le ')")
def filter_contains(spark, sf):
    return _where(
        spark, sf, "corpus.documents", ("doc_id", "n_chars"), ("text", "contains", "é LE ")
    )


@query(f"SELECT p_partkey, p_name FROM part WHERE starts_with({_FOLD.format('p_name')}, 'red ')")
def filter_startswith(spark, sf):
    return _where(
        spark, sf, "sales.part", ("p_partkey", "p_name"), ("p_name", "startswith", "RED ")
    )


@query(f"SELECT p_partkey, p_name FROM part WHERE ends_with({_FOLD.format('p_name')}, 'widget')")
def filter_endswith(spark, sf):
    return _where(
        spark, sf, "sales.part", ("p_partkey", "p_name"), ("p_name", "endswith", "Widget")
    )


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def filter_gt(spark, sf):
    return _where(spark, sf, "sales.part", ("p_partkey", "p_size"), ("p_size", "gt", "25"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 250000.5")
def filter_gte(spark, sf):
    return _where(spark, sf, "sales.orders", _ORDER, ("o_totalprice", "gte", "250000.5"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1996-07-01'")
def filter_lt(spark, sf):
    return _where(
        spark, sf, "sales.orders", ("o_orderkey", "o_orderdate"),
        ("o_orderdate", "lt", "1996-07-01"),
    )


@query("SELECT event_id, event_type FROM events WHERE event_type <= 'error'")
def filter_lte(spark, sf):
    return _where(
        spark, sf, "telemetry.events", ("event_id", "event_type"), ("event_type", "lte", "error")
    )


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"
)
def filter_in(spark, sf):
    wanted = ["1-URGENT", "5-LOW"]
    return _where(spark, sf, "sales.orders", _ORDER, ("o_orderpriority", "in", wanted))


@query(
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders "
    "WHERE nullif(o_orderstatus, 'P') NOT IN ('F')"
)
def filter_notin(spark, sf):
    rows = apply_filters(
        _nullable_orders(spark, sf), [{"column": "status", "op": "notin", "value": ["F"]}]
    )
    return rows.select("o_orderkey", "status")


def _days(first: date, last: date) -> list[str]:
    return [(first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]


@query(
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate "
    "BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31'"
)
def filter_in_long_list(spark, sf):
    days = _days(date(1995, 1, 1), date(1998, 12, 31))
    return _where(
        spark, sf, "sales.orders", ("o_orderkey", "o_orderdate"), ("o_orderdate", "in", days)
    )


@query(
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate NOT "
    "BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31'"
)
def filter_notin_long_list(spark, sf):
    days = _days(date(1995, 1, 1), date(1998, 12, 31))
    return _where(
        spark, sf, "sales.orders", ("o_orderkey", "o_orderdate"), ("o_orderdate", "notin", days)
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL")
def filter_isnull(spark, sf):
    rows = apply_filters(_nullable_orders(spark, sf), [{"column": "status", "op": "isnull"}])
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders "
    "WHERE nullif(o_orderstatus, 'P') IS NOT NULL"
)
def filter_notnull(spark, sf):
    rows = apply_filters(_nullable_orders(spark, sf), [{"column": "status", "op": "notnull"}])
    return rows.select("o_orderkey", "status")


@query(
    "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem "
    "WHERE l_quantity >= 20 AND l_quantity < 30 AND l_returnflag = 'R' "
    "AND l_shipdate >= TIMESTAMP '1997-01-01'"
)
def filter_conjunction(spark, sf):
    return _where(
        spark, sf, "sales.lineitem", ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate"),
        ("l_quantity", "gte", 20), ("l_quantity", "lt", 30), ("l_returnflag", "exact", "R"),
        ("l_shipdate", "gte", "1997-01-01"),
    )


@query(
    "SELECT p_partkey, p_size, p_retailprice FROM part "
    "WHERE p_size IN (7, 11) AND p_retailprice <> 900.1"
)
def filter_typed_values(spark, sf):
    return _where(
        spark, sf, "sales.part", ("p_partkey", "p_size", "p_retailprice"),
        ("p_size", "in", ["7", 11.0, "11.5", "x"]), ("p_retailprice", "not", "900.1"),
    )


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, "
    "'Order ' || o_orderkey || ' of customer ' || o_custkey || ' (' || o_orderpriority || ')' "
    "AS _citation FROM orders "
    "WHERE o_totalprice >= 100000 AND starts_with(o_orderpriority, '1') "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"
)
def top_orders(spark, sf):
    return desk(spark, sf).query_table(
        "sales",
        "orders",
        filters=[
            {"column": "o_totalprice", "op": "gte", "value": 100000},
            {"column": "o_orderpriority", "op": "startswith", "value": "1"},
        ],
        sort="-o_totalprice",
    ).data
