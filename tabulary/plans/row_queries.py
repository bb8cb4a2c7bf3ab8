"""Projection, enrichment, ordering and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.envelope import provenance_for
from tabulary.operators import paging, projection, quality
from tabulary.plans.bindings import CC_BY, REGISTRY, RETRIEVED_AT, RETRIEVED_TEXT
from tabulary.plans.catalogue import desk, query, table
from tabulary.session import drop_path, local_frame, work_path


def _enriched(spark, sf, name, columns=None):
    database, short = name.split(".")
    df = table(spark, sf, name)
    spec = REGISTRY.any_table(database, short)
    return df.select(
        *projection.enrich(REGISTRY, database, spec, df, columns, RETRIEVED_AT)
    )


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def visible_columns(spark, sf):
    df = table(spark, sf, "sales.supplier")
    spec = REGISTRY.any_table("sales", "supplier")
    return df.select(*REGISTRY.visible_columns(spec, df.columns))


_DOC_CITATION = (
    f"source || '/' || doc_id || ' (' || lang || '), retrieved {RETRIEVED_TEXT}' AS _citation"
)


@query(f"SELECT doc_id, lang, source, n_chars, {_DOC_CITATION} FROM documents")
def default_projection(spark, sf):
    return _enriched(spark, sf, "corpus.documents")


@query(
    "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey, "
    f"' (retrieved {RETRIEVED_TEXT})' AS _citation FROM customer"
)
def unconfigured_projection(spark, sf):
    return _enriched(spark, sf, "sales.customer")


@query(
    "SELECT p_type, p_name, p_name || ' (' || p_brand || ') row://part/' || p_partkey "
    "AS _citation FROM part"
)
def explicit_projection(spark, sf):
    return _enriched(spark, sf, "sales.part", ["p_type", "p_name"])


@query(
    "SELECT doc_id, text AS rc_text, 'Document providers' AS policy_source, "
    "'Provider terms' AS policy_license, CAST(NULL AS VARCHAR) AS policy_license_url, "
    f"'process-only' AS policy_redistribution, {_DOC_CITATION} FROM documents"
)
def heavy_content(spark, sf):
    rows = _enriched(spark, sf, "corpus.documents", ["doc_id", "text"])
    nest, policy = F.col(projection.NEST), F.col(f"{projection.NEST}.{projection.POLICY}")
    terms = ("source", "license", "license_url", "redistribution")
    return rows.select(
        "doc_id",
        nest["text"].alias("rc_text"),
        *[policy[t].alias(f"policy_{t}") for t in terms],
        projection.CITATION,
    )


@query(
    "SELECT page_id, html AS rc_html, 'corpus' AS policy_source, 'ODC-BY' AS policy_license, "
    "'https://opendatacommons.org/licenses/by/1-0/' AS policy_license_url, "
    "'allowed' AS policy_redistribution FROM pages"
)
def heavy_content_default_policy(spark, sf):
    rows = _enriched(spark, sf, "corpus.pages", ["page_id", "html"])
    policy = F.col(f"{projection.NEST}.{projection.POLICY}")
    terms = ("source", "license", "license_url", "redistribution")
    return rows.select(
        "page_id",
        F.col(f"{projection.NEST}.html").alias("rc_html"),
        *[policy[t].alias(f"policy_{t}") for t in terms],
    )


#: The visible tables with a url of each row.
_WITH_URL = ("corpus.documents", "corpus.conversations", "corpus.pages", "corpus.benchmark", "sales.part")


def _labelled_rows(spark, sf):
    """Rows of several tables with the license each carries."""
    parts = []
    for name in _WITH_URL:
        database, short = name.split(".")
        text, url = REGISTRY.database(database).license_pair()
        parts.append(
            table(spark, sf, name).select(
                "url",
                F.lit(database).alias("database"),
                F.lit(short).alias("table"),
                F.lit(text).alias("license"),
                F.lit(url).alias("license_url"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    "SELECT 'row://documents/' || doc_id AS url, 'Document providers' AS policy_source, "
    "'Provider terms' AS policy_license, 'process-only' AS policy_redistribution "
    "FROM documents UNION ALL "
    "SELECT 'row://conversations/' || conv_id || '/' || turn, 'corpus', 'ODC-BY', 'allowed' "
    "FROM conversations UNION ALL "
    "SELECT url, 'corpus', 'ODC-BY', 'allowed' FROM pages UNION ALL "
    "SELECT 'row://benchmark/' || item_id, 'corpus', 'ODC-BY', 'allowed' FROM benchmark UNION ALL "
    "SELECT 'row://part/' || p_partkey, 'sales', 'CC-BY-4.0', 'allowed' FROM part"
)
def mixed_table_policies(spark, sf):
    listed = [
        (d.name, t.name, t.policy.source, t.policy.license, t.policy.license_url,
         t.policy.redistribution)
        for d in REGISTRY.databases.values()
        for t in d.tables
        if t.policy is not None
    ]
    policies = local_frame(
        spark,
        listed,
        "database string, table string, source string, license string, license_url string, "
        "redistribution string",
    )
    rows = projection.attach_policies(_labelled_rows(spark, sf), policies)
    policy = F.col(projection.POLICY)
    return rows.select(
        "url",
        *[policy[t].alias(f"policy_{t}") for t in ("source", "license", "redistribution")],
    )


@query(
    "SELECT item_id, 'row://benchmark/' || item_id || "
    f"' (retrieved {RETRIEVED_TEXT})' AS _citation FROM benchmark"
)
def default_citation(spark, sf):
    return _enriched(spark, sf, "corpus.benchmark", ["item_id"])


@query(
    "SELECT o_orderkey, '[' || coalesce(nullif(o_orderstatus, 'P'), '') || '] ' || "
    "o_orderpriority || ' ' AS _citation FROM orders"
)
def citation_of_nulls(spark, sf):
    orders = table(spark, sf, "sales.orders")
    orders = orders.withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    template = "[{status}] {o_orderpriority} {missing}"
    cite = projection.citation(template, orders.columns, RETRIEVED_AT)
    return orders.select("o_orderkey", cite)


def _license_rows() -> str:
    tables = {
        "sales": ("orders", "lineitem", "customer", "part", "supplier", "nation", "region"),
        "corpus": ("documents", "pages", "conversations", "benchmark"),
        "telemetry": ("events",),
    }
    terms = {
        "sales": ("CC-BY-4.0", CC_BY),
        "corpus": ("ODC-BY", "https://opendatacommons.org/licenses/by/1-0/"),
        "telemetry": ("CC-BY-4.0", CC_BY),
    }
    return " UNION ALL ".join(
        f"SELECT '{d}' AS database, '{t}' AS \"table\", '{terms[d][0]}' AS license, "
        f"'{terms[d][1]}' AS license_url, '{RETRIEVED_TEXT}' AS retrieved_at, "
        f"'{REGISTRY.source}' AS source, '{REGISTRY.attribution}' AS attribution, "
        f"count(*) AS row_count FROM {t}"
        for d, names in tables.items()
        for t in names
    )


@query(_license_rows())
def provenance_by_table(spark, sf):
    parts = []
    for database in REGISTRY.databases:
        for spec in REGISTRY.visible_tables(database):
            if spec.path is not None:
                continue  # a view over another listed table
            p = provenance_for(REGISTRY, RETRIEVED_AT, database, spec.name)
            count = table(spark, sf, f"{database}.{spec.name}").agg(
                F.count("*").alias("row_count")
            )
            parts.append(
                count.select(
                    F.lit(database).alias("database"),
                    F.lit(spec.name).alias("table"),
                    F.lit(p.license).alias("license"),
                    F.lit(p.license_url).alias("license_url"),
                    F.lit(p.retrieved_at.isoformat()).alias("retrieved_at"),
                    F.lit(p.source).alias("source"),
                    F.lit(p.attribution).alias("attribution"),
                    "row_count",
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "SELECT l_linenumber, l_extendedprice, l_partkey, "
    "'Part ' || l_partkey || ', line ' || l_linenumber AS _citation FROM lineitem "
    "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 200"
)
def sorted_page(spark, sf):
    return desk(spark, sf).query_table(
        "sales", "lineitem", sort="-l_extendedprice", limit=200,
        columns=["l_linenumber", "l_extendedprice", "l_partkey"],
    ).data


@query(
    f"SELECT doc_id, lang, source, n_chars, {_DOC_CITATION} FROM documents "
    "ORDER BY doc_id LIMIT 50"
)
def default_order_page(spark, sf):
    return desk(spark, sf).query_table("corpus", "documents").data


@query(
    f"SELECT doc_id, text AS rc_text, {_DOC_CITATION} FROM documents WHERE lang <> 'en' "
    "ORDER BY n_chars DESC, doc_id LIMIT 100"
)
def heavy_page(spark, sf):
    rows = desk(spark, sf).query_table(
        "corpus", "documents", sort="-n_chars", limit=100, columns=["doc_id", "text"],
        filters=[{"column": "lang", "op": "not", "value": "en"}],
    ).data
    return rows.select(
        "doc_id", F.col(f"{projection.NEST}.text").alias("rc_text"), projection.CITATION
    )


_STATUS_ORDER = "nullif(o_orderstatus, 'P') ASC NULLS FIRST, o_orderkey"


def _status_orders(spark, sf):
    return table(spark, sf, "sales.orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")
    )


@query(
    "SELECT o_orderkey, o_totalprice FROM orders "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 200"
)
def next_page(spark, sf):
    rows = table(spark, sf, "sales.orders").select("o_orderkey", "o_totalprice")
    keys = paging.sort_keys("-o_totalprice", ["o_orderkey"])
    position, _ = paging.page_end(rows, keys, 200)
    return paging.page(rows, keys, 200, position)


@query(
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders "
    f"ORDER BY {_STATUS_ORDER} LIMIT 200 OFFSET 200"
)
def next_page_with_nulls(spark, sf):
    rows = _status_orders(spark, sf)
    keys = paging.sort_keys("status", ["o_orderkey"])
    position, _ = paging.page_end(rows, keys, 200)
    return paging.page(rows, keys, 200, position)


_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    "SELECT l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem "
    f"ORDER BY l_quantity DESC, l_orderkey, {_LINES} LIMIT 100 OFFSET 200"
)
def next_page_sealed(spark, sf):
    """The third page of a table whose key is hidden, by way of the sealed positions before it."""
    served, position = desk(spark, sf), None
    for _ in range(2):
        page = served.query_table("sales", "lineitem", sort="-l_quantity", limit=100, position=position)
        position = page.pagination().next_position
    page = served.query_table("sales", "lineitem", sort="-l_quantity", limit=100, position=position)
    return page.data.select("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")


@query(
    "SELECT count(*) AS total, count(*) > 200 AS has_more FROM orders WHERE o_totalprice >= 100000"
)
def filtered_total(spark, sf):
    """The total of a filtered request, and whether a first page of 200 leaves rows."""
    clauses = [{"column": "o_totalprice", "op": "gte", "value": 100000}]
    served = desk(spark, sf)
    page = served.query_table("sales", "orders", clauses, limit=200).pagination()
    total = served.count_rows("sales", "orders", clauses)
    return local_frame(spark, [(total, page.truncated)], "total long, has_more boolean")


@query(
    "SELECT o_orderkey, position, (position - 1) // 100 AS page FROM (SELECT o_orderkey, "
    f"row_number() OVER (ORDER BY {_STATUS_ORDER}) AS position FROM orders)"
)
def page_walk(spark, sf):
    keys = paging.sort_keys("status", ["o_orderkey"])
    pages = paging.assign_pages(_status_orders(spark, sf), keys, 100)
    return pages.select("o_orderkey", "position", "page")


#: Visible tables with heavy text: the key that is shown, and the text.
_HEAVY = {
    "corpus.documents": (["doc_id"], "text"),
    "corpus.pages": (["page_id"], "html"),
    "corpus.conversations": (["conv_id", "turn"], "text"),
    "corpus.benchmark": (["item_id"], "text"),
}


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", count(*) AS compared, CAST(0 AS BIGINT) AS changed, "
        f"CAST(0 AS BIGINT) AS missing FROM {n.split('.')[1]}"
        for n in _HEAVY
    )
)
def text_unchanged(spark, sf):
    """Heavy text after projection, a write and a read, against the source."""
    parts = []
    for name, (key, text) in _HEAVY.items():
        path = work_path(spark, "served")
        served = _enriched(spark, sf, name, [*key, text])
        served.select(*key, F.col(f"{projection.NEST}.{text}").alias("served")).write.parquet(path)
        compared = quality.changed_text(
            table(spark, sf, name), spark.read.parquet(path), key, text, "served"
        ).first()  # one row of three counts
        drop_path(spark, path)
        parts.append((name, *compared))
    return local_frame(spark, parts, "table string, compared long, changed long, missing long")


_VISIBLE = [
    f"{d}.{t.name}" for d in REGISTRY.databases for t in REGISTRY.visible_tables(d)
]


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", {rows} AS checked, CAST(0 AS BIGINT) AS uncited"
        for n in _VISIBLE
        for rows in [
            "(SELECT count(DISTINCT conv_id) FROM conversations)"
            if n == "corpus.threads"
            else f"(SELECT count(*) FROM {n.split('.')[1]})"
        ]
    )
)
def citations_complete(spark, sf):
    parts = []
    for name in _VISIBLE:
        rows = _enriched(spark, sf, name).select(F.lit(name).alias("table"), projection.CITATION)
        parts.append(
            rows.select("table", F.lit(1).alias("checked"), F.lit(0).alias("uncited")).unionByName(
                quality.uncited(rows).select("table", F.lit(0).alias("checked"), F.lit(1).alias("uncited"))
            )
        )
    return reduce(DataFrame.unionByName, parts).groupBy("table").agg(
        F.sum("checked").alias("checked"), F.sum("uncited").alias("uncited")
    )
