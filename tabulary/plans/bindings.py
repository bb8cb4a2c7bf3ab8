"""The registry over the star-schema and text tables used by the registered queries."""

from __future__ import annotations

from datetime import UTC, datetime

from tabulary.registry import DatabaseSpec, FragmentLink, Policy, Registry, TableSpec

#: The retrieval time stamped by registered queries, fixed so that results can be compared.
RETRIEVED_AT = datetime(2026, 1, 15, 12, 0, tzinfo=UTC)
RETRIEVED_TEXT = RETRIEVED_AT.isoformat()

CC_BY = "https://creativecommons.org/licenses/by/4.0/"
_BY_PK = {"date": None, "summary": None}

LINEITEM_COLUMNS = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)

SALES = DatabaseSpec(
    name="sales",
    description="Orders, parts and customers.",
    license="CC-BY-4.0",
    license_url=CC_BY,
    tables=(
        TableSpec(
            "orders",
            key=("o_orderkey",),
            light=("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"),
            url_column="o_custkey",
            citation="Order {o_orderkey} of customer {o_custkey} ({o_orderpriority})",
            description="Customer orders.",
            column_descriptions={"o_totalprice": "Order value"},
        ),
        # (l_orderkey, l_linenumber) repeats, so the key needs the remaining columns.
        TableSpec(
            "lineitem",
            key=("l_orderkey", *LINEITEM_COLUMNS),
            hidden_columns=frozenset({"l_orderkey"}),
            light=("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"),
            link=FragmentLink("orders", "l_orderkey", "o_orderkey", "l_linenumber", "o_orderdate"),
            citation="Part {l_partkey}, line {l_linenumber}",
            description="Order lines.",
        ),
        TableSpec("customer", key=("c_custkey",), description="Customers."),
        TableSpec(
            "part",
            key=("p_partkey",),
            light=("p_partkey", "p_name", "p_brand", "p_type"),
            derived={"title": "p_name", "url": "concat('row://part/', p_partkey)"},
            search_columns=("p_name",),
            default_sort="p_name",
            preview=_BY_PK,
            citation="{p_name} ({p_brand}) {url}",
            upstream_description="Parts on offer.",
            description="Parts.",
        ),
        TableSpec(
            "supplier", key=("s_suppkey",), hidden_columns=frozenset({"s_acctbal"})
        ),
        TableSpec("nation", key=("n_nationkey",)),
        TableSpec("region", key=("r_regionkey",)),
    ),
)

CORPUS = DatabaseSpec(
    name="corpus",
    description="Documents, pages and dialogues.",
    license="ODC-BY",
    license_url="https://opendatacommons.org/licenses/by/1-0/",
    denied_tables=frozenset({"embeddings"}),
    tables=(
        TableSpec(
            "documents",
            key=("doc_id",),
            light=("doc_id", "lang", "source", "n_chars"),
            derived={
                "title": "concat(source, ' ', lang)",
                "url": "concat('row://documents/', doc_id)",
            },
            search_columns=("text",),
            default_sort="-n_chars",
            preview=_BY_PK,
            citation="{source}/{doc_id} ({lang}), retrieved {retrieved_at}",
            policy=Policy("Document providers", "Provider terms", None, "process-only"),
            description="Documents in four languages.",
        ),
        TableSpec(
            "pages",
            key=("page_id",),
            url_column="url",
            derived={"title": "url"},
            search_columns=("url",),
            preview=_BY_PK,
            description="Raw web pages.",
        ),
        TableSpec(
            "conversations",
            key=("conv_id", "turn"),
            light=("turn", "role"),
            derived={
                "title": "concat('Dialogue ', conv_id)",
                "url": "concat('row://conversations/', conv_id, '/', turn)",
            },
            link=FragmentLink("threads", "conv_id", "conv_id", "turn", "turn"),
            search_columns=("text",),
            preview=_BY_PK,
            citation="{title}, turn {turn}",
            description="Dialogue turns.",
        ),
        TableSpec(
            "threads",
            key=("conv_id",),
            path="conversations.parquet",
            first_by="turn",
            derived={"thread_url": "concat('row://threads/', conv_id)"},
            url_column="thread_url",
            light=("thread_url", "role"),
            citation="{thread_url}",
            description="One row per dialogue.",
        ),
        TableSpec(
            "benchmark",
            key=("item_id",),
            derived={
                "title": "concat('Item ', item_id)",
                "url": "concat('row://benchmark/', item_id)",
            },
            search_columns=("text",),
            preview=_BY_PK,
        ),
        TableSpec("labels", key=("doc_id",), hidden=True),
        TableSpec("embeddings", key=("vec_id",)),
    ),
)

TELEMETRY = DatabaseSpec(
    name="telemetry",
    description="Service events.",
    license="CC-BY-4.0",
    license_url=CC_BY,
    tables=(
        TableSpec(
            "events",
            key=("event_id",),
            light=("event_id", "ts", "event_type", "value"),
            description="Request log.",
        ),
    ),
)

REGISTRY = Registry(
    [SALES, CORPUS, TELEMETRY],
    heavy=("text", "html"),
    source="star-schema and text tables",
    attribution="Generated test data",
)
