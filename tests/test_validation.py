"""Validation of a table of requests: every code against the call itself."""

from __future__ import annotations

import pytest

from tabulary.errors import QueryError
from tabulary.operators.validation import REQUEST, request_codes
from tabulary.plans import catalog_queries
from tabulary.plans.catalogue import desk as open_desk
from tabulary.plans.catalogue import table

_ORDER = '[{"column": "o_custkey", "op": "exact", "value": 7}%s]'
#: Requests on the pages of a table: (database, table, other arguments).
PAGES = [
    ("sales", "lineitem", {"filters": _ORDER % ""}),
    ("sales", "lineitem", {"filters": _ORDER % "", "limit": 150}),
    ("sales", "lineitem", {"filters": _ORDER % "", "position": "[1, 2, 3]"}),
    ("sales", "lineitem", {"filters": _ORDER % ', {"column": "l_orderkey", "op": "isnull"}'}),
    ("sales", "lineitem", {"filters": _ORDER % ', {"column": "l_quantity", "op": "gt", "value": "x"}'}),
    ("sales", "lineitem", {"filters": _ORDER % ', {"column": "l_quantity", "op": "gt", "value": "1e3"}'}),
    ("sales", "lineitem", {"filters": '[{"column": "o_custkey", "op": "gt", "value": 7}]'}),
    ("sales", "lineitem", {"sort": "-l_tax", "filters": '[{"column": "l_shipdate", "op": "lt", "value": "1995-01-01"}]'}),
    ("sales", "lineitem", {"filters": '[{"column": "l_shipdate", "op": "lt", "value": "soon"}]'}),
    ("corpus", "documents", {"columns": '["text", "lang"]', "filters": '[{"column": "lang", "op": "gt", "value": 5}]'}),
    ("corpus", "documents", {"columns": '["texts"]'}),
    ("corpus", "documents", {"limit": 0}),
    ("corpus", "documents", {"limit": 200, "position": "[5]"}),
    ("corpus", "conversations", {"position": "[5, 1]"}),
    ("corpus", "conversations", {"position": "[5]"}),
    ("corpus", "conversations", {"sort": "role", "position": '["user", 5]'}),
    ("corpus", "labels", {}),
    ("corpus", "nothing", {}),
    ("sales", "supplier", {"sort": "s_acctbal"}),
    ("sales", "supplier", {"filters": '[{"column": "s_acctbal", "op": "isnull"}]'}),
    ("nowhere", "orders", {}),
]


def _call(desk, r):
    """What the call itself says."""
    import json

    def decoded(text):
        try:
            return None if text is None else json.loads(text)
        except ValueError:
            return text

    def page():
        limit = {} if r["limit"] is None else {"limit": r["limit"]}
        position = decoded(r["position"])
        if isinstance(position, str):
            position = [position] * 99  # what cannot be read has no page's length
        desk.query_table(
            r["database"], r["table"], r["filters"], r["sort"], columns=r["columns"], position=position, **limit
        )

    calls = {
        "list_databases": lambda: desk.list_databases(),
        "list_tables": lambda: desk.list_tables(r["database"]),
        "describe_table": lambda: desk.describe_table(r["database"], r["table"]),
        "query_table": page,
        "fetch": lambda: desk.fetch(r["database"], r["table"], r["url"]),
        "search": lambda: desk.search(r["query"] or "", r["databases"], **({} if r["limit"] is None else {"limit": r["limit"]})),
    }
    try:
        calls[r["call"]]()
    except QueryError as error:
        return error.code
    return "ok"


def _codes(spark, sf, rows):
    served = open_desk(spark, sf)
    made = request_codes(spark.createDataFrame(rows, REQUEST), served.registry, served.open)
    return made, served


def test_codes_are_those_of_the_calls(spark, sf):
    names = [f.split()[0] for f in REQUEST.split(", ")]
    asked = table(spark, sf, "telemetry.events").selectExpr(*[f"{q} AS `{n}`" for n, q in catalog_queries._ASKED.items()])
    rows = [r.asDict() for r in asked.orderBy("event_id").limit(500).collect()]
    rows = [r for r in rows if r["call"] in ("query_table", "search")][::5]
    pages = [dict.fromkeys(names) | {"call": "query_table", "database": d, "table": t} | more for d, t, more in PAGES]
    offered = [tuple(r[n] for n in names) for r in [*rows, *pages]]
    made, served = _codes(spark, sf, offered)
    got = {tuple(r[n] for n in names): r["code"] for r in made.collect()}
    for request in offered:
        assert got[request] == _call(served, dict(zip(names, request, strict=True))), request


@pytest.mark.parametrize("url, code", [("https://nowhere", "not_found"), (None, "not_found"), (0, "ok")])
def test_fetch_codes(spark, sf, url, code):
    if url == 0:
        url = table(spark, sf, "corpus.pages").first()["url"]
    rows = [("fetch", "corpus", "pages", None, None, None, None, None, None, None, url)]
    made, _ = _codes(spark, sf, rows)
    assert [r["code"] for r in made.collect()] == [code]


def test_a_search_without_searchable_tables_is_empty(spark, sf):
    rows = [("search", None, None, None, None, None, None, None, "x", d, None) for d in ('["telemetry"]', None)]
    made, served = _codes(spark, sf, rows)
    got = {r["databases"]: (r["code"], r["searched"]) for r in made.collect()}
    assert got['["telemetry"]'] == ("ok", 0) and got[None][0] == "ok" and got[None][1] > 0
    answer = served.search("x", ["telemetry"])
    assert answer.data.collect() == [] and not answer.pagination().upstream_total_hits


def test_no_requests_and_extra_columns(spark, sf):
    served = open_desk(spark, sf)
    none = spark.createDataFrame([], REQUEST).selectExpr("*", "1 as _table_id", "'a' as note")
    made = request_codes(none, served.registry, served.open)
    assert made.collect() == [] and made.columns[-4:] == ["_table_id", "note", "code", "searched"]


def test_the_query_runs_no_job_per_request(spark, sf):
    spark.sparkContext.setJobGroup("codes", "codes")
    try:
        catalog_queries.request_codes(spark, sf).count()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("codes")) < 40
