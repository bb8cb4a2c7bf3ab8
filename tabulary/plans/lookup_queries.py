"""Lookups by natural key and parent-to-fragment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.operators import fragments, lookup
from tabulary.plans.bindings import LINEITEM_COLUMNS, REGISTRY, RETRIEVED_TEXT
from tabulary.plans.catalogue import desk, query, table
from tabulary.registry import FragmentLink

_ORDERS = REGISTRY.any_table("sales", "orders")
_LINES = REGISTRY.any_table("sales", "lineitem")
_TURNS = REGISTRY.any_table("corpus", "conversations")

#: Columns of a line in the fragment queries: enough to tell any two lines apart.
_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")

#: The latest order of each customer, spelled for the oracles.
_LATEST = (
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
)


def _page_requests(spark, sf):
    """Every page url, and for every page one url that no page has."""
    pages = table(spark, sf, "corpus.pages")
    return pages.select(F.explode(F.array("url", F.concat("url", F.lit("~")))).alias("url"))


def _customer_requests(spark, sf):
    return table(spark, sf, "sales.customer").select(F.col("c_custkey").alias("url"))


@query(
    "SELECT r.url, count(p.page_id) AS match_count, min(p.page_id) AS page_id, "
    "min(p.url) AS title, min(p.url) AS row_url, "
    f"min(p.url || ' (retrieved {RETRIEVED_TEXT})') AS _citation "
    "FROM (SELECT url FROM pages UNION SELECT url || '~' FROM pages) r "
    "LEFT JOIN pages p ON p.url = r.url GROUP BY r.url"
)
def fetch_by_url(spark, sf):
    return desk(spark, sf).fetch_many("corpus", "pages", _page_requests(spark, sf)).data


@query(
    "SELECT c_custkey AS url, count(o_orderkey) AS match_count, min(o_orderkey) AS o_orderkey, "
    "arg_min(o_totalprice, o_orderkey) AS o_totalprice "
    "FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"
)
def fetch_first_of_many(spark, sf):
    return lookup.fetch_many(
        table(spark, sf, "sales.orders"), "o_custkey", ["o_orderkey"],
        ["o_orderkey", "o_totalprice"], _customer_requests(spark, sf),
    )


@query(
    "SELECT o_custkey AS url, count(*) AS match_count FROM orders "
    "WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey HAVING count(*) > 1"
)
def ambiguous_keys(spark, sf):
    return lookup.ambiguous(fetch_first_of_many(spark, sf))


@query(
    "SELECT DISTINCT url || '~' AS url FROM pages "
    "WHERE url || '~' NOT IN (SELECT url FROM pages)"
)
def keys_not_found(spark, sf):
    pages = table(spark, sf, "corpus.pages")
    return lookup.not_found(pages, "url", _page_requests(spark, sf))


_BARE = (
    "regexp_replace(regexp_replace({}, '^https?://', ''), '/+($|[?#])', '\\1')"
)


@query(
    "SELECT r.url, count(p.page_id) AS match_count, min(p.page_id) AS page_id FROM "
    f"(SELECT DISTINCT replace(url, 'https://', 'HTTP://') AS url, {_BARE.format('url')} AS bare "
    f"FROM pages) r LEFT JOIN (SELECT page_id, {_BARE.format('url')} AS bare FROM pages) p "
    "ON p.bare = r.bare GROUP BY r.url"
)
def fetch_by_normalized_url(spark, sf):
    pages = table(spark, sf, "corpus.pages")
    requests = pages.select(F.replace("url", F.lit("https://"), F.lit("HTTP://")).alias("url"))
    return lookup.fetch_many(
        pages, "url", ["page_id"], ["page_id"], requests, match="normalized"
    )


@query(
    f"SELECT {', '.join(_LINE)} FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM orders "
    "WHERE o_custkey = 899 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)"
)
def fragments_of_one_parent(spark, sf):
    return fragments.fragments_of(
        table(spark, sf, "sales.lineitem"), table(spark, sf, "sales.orders"), "o_custkey",
        _LINES.link, _ORDERS.key, 899,
    ).select(*_LINE)


@query(
    "SELECT l_linenumber, l_partkey, 'Part ' || l_partkey || ', line ' || l_linenumber "
    "AS _citation FROM lineitem WHERE l_quantity >= 10 AND l_orderkey = "
    "(SELECT o_orderkey FROM orders WHERE o_custkey = 899 "
    "ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) "
    f"ORDER BY l_linenumber, l_orderkey, {', '.join(LINEITEM_COLUMNS[1:])} LIMIT 100"
)
def fragment_page(spark, sf):
    return desk(spark, sf).query_table(
        "sales", "lineitem", limit=100, columns=["l_linenumber", "l_partkey"],
        filters=[
            {"column": "o_custkey", "op": "exact", "value": 899},
            {"column": "l_quantity", "op": "gte", "value": 10},
        ],
    ).data


@query(
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
)
def latest_parent_per_key(spark, sf):
    orders = table(spark, sf, "sales.orders")
    latest = fragments.latest_parents(orders, "o_custkey", _LINES.link, _ORDERS.key)
    return latest.select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    "SELECT substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) AS parent_url_hash, "
    "count(*) AS parent_match_count, max(o_orderdate) AS selected_parent_match_value "
    "FROM orders GROUP BY o_custkey HAVING count(*) > 1"
)
def duplicate_parents(spark, sf):
    orders = table(spark, sf, "sales.orders")
    return fragments.multi_match_report(orders, "o_custkey", _LINES.link)


@query(
    f"SELECT o_custkey AS url, {', '.join(_LINE)}, row_number() OVER (PARTITION BY o_custkey "
    f"ORDER BY l_linenumber, l_orderkey, {', '.join(LINEITEM_COLUMNS[1:])}) AS position "
    f"FROM lineitem JOIN ({_LATEST}) ON l_orderkey = o_orderkey "
    "WHERE o_custkey IN (SELECT c_custkey FROM customer)"
)
def fragment_walk(spark, sf):
    return fragments.walk(
        table(spark, sf, "sales.lineitem"), table(spark, sf, "sales.orders"), "o_custkey",
        _LINES.link, _ORDERS.key, _LINES.key, _customer_requests(spark, sf),
    ).select(F.col("parent_url").alias("url"), *_LINE, "position")


@query(
    "SELECT 'row://threads/' || conv_id AS url, turn, role, text, "
    "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations "
)
def dialogue_walk(spark, sf):
    threads = table(spark, sf, "corpus.threads")
    return fragments.walk(
        table(spark, sf, "corpus.conversations"), threads, "thread_url", _TURNS.link,
        ("conv_id",), _TURNS.key, threads.select(F.col("thread_url").alias("url")),
    ).select(F.col("parent_url").alias("url"), "turn", "role", "text", "position")


@query(
    "SELECT r.url, p.page_id, p.page_id AS part_no FROM "
    f"(SELECT DISTINCT replace(url, 'https://', 'HTTP://') AS url, {_BARE.format('url')} AS bare "
    f"FROM pages) r JOIN (SELECT page_id, {_BARE.format('url')} AS bare FROM pages "
    f"QUALIFY row_number() OVER (PARTITION BY {_BARE.format('url')} ORDER BY page_id DESC) = 1) p "
    "ON p.bare = r.bare"
)
def fragments_by_normalized_url(spark, sf):
    pages = table(spark, sf, "corpus.pages")
    requests = pages.select(F.replace("url", F.lit("https://"), F.lit("HTTP://")).alias("url"))
    parts = pages.select(F.col("page_id").alias("owner"), F.col("page_id").alias("part_no"))
    link = FragmentLink("pages", "owner", "page_id", "part_no", "page_id")
    found = fragments.fragments_of_many(
        parts, pages, "url", link, ("page_id",), requests, match="normalized"
    )
    return found.select(F.col("parent_url").alias("url"), F.col("owner").alias("page_id"), "part_no")


@query(
    "SELECT p_partkey AS url FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)"
)
def parents_not_found(spark, sf):
    orders = table(spark, sf, "sales.orders")
    requests = table(spark, sf, "sales.part").select(F.col("p_partkey").alias("url"))
    return fragments.unknown_parents(orders, "o_custkey", requests)
