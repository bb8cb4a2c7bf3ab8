"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulary.functions import clock, json_args, network, text, urls
from tabulary.operators import quality
from tabulary.plans.catalogue import query, table


def _url_sql(column: str) -> str:
    scheme = f"lower(regexp_extract({column}, '^([A-Za-z]+)://', 1))"
    host = f"lower(regexp_extract({column}, '^[A-Za-z]+://([^/?#]*)', 1))"
    path = f"regexp_extract({column}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    rest = f"regexp_extract({column}, '^[^?#]*(.*)$', 1)"
    return (
        f"(CASE {scheme} WHEN 'http' THEN 'https' ELSE {scheme} END || '://' || {host} || "
        f"CASE WHEN length({path}) > 1 THEN rtrim({path}, '/') ELSE {path} END || {rest})"
    )


@query(f"SELECT page_id, {_url_sql('url')} AS normalized FROM pages")
def normalized_urls(spark, sf):
    pages = table(spark, sf, "corpus.pages")
    spaced = F.concat(F.lit("  "), F.col("url"), F.lit(" "))
    return pages.select("page_id", urls.normalize_url(spaced).alias("normalized"))


@query(f"SELECT page_id, substr(sha256({_url_sql('url')}), 1, 16) AS url_hash FROM pages")
def url_hashes(spark, sf):
    pages = table(spark, sf, "corpus.pages")
    return pages.select("page_id", urls.url_hash(urls.normalize_url("url")).alias("url_hash"))


@query(
    "SELECT event_id, CASE event_type "
    "WHEN 'click' THEN CASE WHEN user_id <= 255 AND event_id % 300 <= 255 "
    "THEN '203.0.' || user_id ELSE '_invalid' END "
    "WHEN 'view' THEN CASE WHEN event_id <= 65535 AND user_id <= 65535 "
    "THEN '2001:db8' || CASE WHEN user_id = 0 THEN '' ELSE ':' || format('{:x}', user_id) END "
    "|| '::' ELSE '_invalid' END "
    "WHEN 'purchase' THEN '2001:db8::' WHEN 'signup' THEN '' ELSE '_invalid' END AS prefix "
    "FROM events"
)
def ip_prefixes(spark, sf):
    events = table(spark, sf, "telemetry.events")
    ip = (
        F.when(
            F.col("event_type") == "click",
            F.concat_ws(".", F.lit("203.0"), "user_id", F.col("event_id") % 300),
        )
        .when(
            F.col("event_type") == "view",
            F.concat(F.lit("2001:DB8:"), F.hex("user_id"), F.lit("::"), F.hex("event_id")),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit("2001:0db8:0000:00ff::"), F.lit("192.0.2.33")),
        )
        .when(F.col("event_type") == "signup", F.lit(""))
        .otherwise(F.col("props"))
    )
    return events.select("event_id", network.ip_prefix(ip).alias("prefix"))


def _forwarded():
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return (
        F.when(
            kind == "click",
            F.concat(F.lit("198.51.100.7, 203.0.113."), user, F.lit(":443 ,10.0.0.1")),
        )
        .when(kind == "view", F.concat(F.lit("[2001:db8::"), user, F.lit("]:8080, 10.0.0.1")))
        .when(kind == "purchase", F.concat(F.lit(" 203.0.113."), user))
        .when(kind == "error", F.lit(" , ,"))
        .otherwise(F.lit(""))
    )


_CLIENT = (
    "CASE event_type WHEN 'click' THEN '203.0.113.' || user_id WHEN 'view' THEN '2001:db8::' || "
    "user_id WHEN 'purchase' THEN '203.0.113.' || user_id WHEN 'error' THEN '' "
    "ELSE '192.0.2.1' END"
)


@query(f"SELECT event_id, {_CLIENT} AS client FROM events")
def client_addresses(spark, sf):
    events = table(spark, sf, "telemetry.events")
    client = network.client_ip(_forwarded(), F.lit("192.0.2.1"), 1)
    return events.select("event_id", client.alias("client"))


@query(
    f"SELECT coalesce(nullif({_CLIENT}, ''), '_unknown') AS quota_key, count(*) AS requests "
    "FROM events GROUP BY 1"
)
def quota_keys(spark, sf):
    client = network.client_ip(_forwarded(), F.lit("192.0.2.1"), 1)
    bracketed = F.when(F.contains(client, F.lit("::")), F.concat(F.lit("["), client, F.lit("]")))
    key = network.ip_key(F.coalesce(bracketed, client))
    events = table(spark, sf, "telemetry.events")
    return events.groupBy(key.alias("quota_key")).agg(F.count("*").alias("requests"))


@query(
    "SELECT event_id, CASE event_type WHEN 'click' THEN user_id <= 255 WHEN 'view' THEN true "
    "WHEN 'purchase' THEN true ELSE false END AS loopback FROM events"
)
def loopback_requests(spark, sf):
    kind = F.col("event_type")
    ip = (
        F.when(kind == "click", F.concat(F.lit("127.0.0."), F.col("user_id").cast("string")))
        .when(kind == "view", F.lit("::1"))
        .when(kind == "purchase", F.lit("0:0:0:0:0:0:0:0001"))
        .when(kind == "signup", F.lit("10.0.0.1"))
        .otherwise(F.col("props"))
    )
    events = table(spark, sf, "telemetry.events")
    return events.select("event_id", network.is_loopback(ip).alias("loopback"))


@query(
    "SELECT event_id, CAST(greatest(1, ceil((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) "
    "- epoch_us(ts)) / 1e6)) AS BIGINT) AS seconds FROM events"
)
def seconds_to_midnight(spark, sf):
    events = table(spark, sf, "telemetry.events")
    return events.select("event_id", clock.seconds_to_midnight(F.col("ts")).alias("seconds"))


@query(
    "SELECT o_orderkey, '[' || year(o_orderdate) || '] SGHC ' || o_orderkey AS citation FROM orders"
)
def neutral_citations(spark, sf):
    orders = table(spark, sf, "sales.orders")
    year, number = F.year("o_orderdate").cast("string"), F.col("o_orderkey").cast("string")
    written = (
        F.when(F.col("o_orderstatus") == "F", F.concat_ws(" ", year, F.lit("SGHC"), number))
        .when(F.col("o_orderstatus") == "O", F.concat_ws("_", year, F.lit("SGHC"), number))
        .otherwise(F.concat(F.lit("["), year, F.lit("] SGHC "), number))
    )
    return orders.select("o_orderkey", text.normalize_citation(written).alias("citation"))


@query(
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false "
    "ELSE length(CAST(o_orderkey AS VARCHAR)) <= 4 END AS valid FROM orders"
)
def request_ids(spark, sf):
    orders = table(spark, sf, "sales.orders")
    number = F.col("o_orderkey").cast("string")
    given = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("req-"), number))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("req "), number))
        .otherwise(F.concat(F.lit("a" * 124), number))
    )
    return orders.select("o_orderkey", text.is_request_id(given).alias("valid"))


@query(
    "SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [p_name] WHEN p_size > 10 "
    "THEN [p_brand, p_type] ELSE ['[\"' || p_name] END) AS item FROM part"
)
def list_arguments(spark, sf):
    part = table(spark, sf, "sales.part")
    given = (
        F.when(F.col("p_size") > 25, F.col("p_name"))
        .when(F.col("p_size") > 10, F.to_json(F.array("p_brand", "p_type")))
        .otherwise(F.concat(F.lit('["'), F.col("p_name")))
    )
    return part.select("p_partkey", F.explode(json_args.list_column(given)).alias("item"))


#: Strings planted in requests, which must not come back in logs, and common ones for contrast.
_PLANTED = ("</system>", "MATCH 'data' AND NEAR(", "NEAR('data' 'protection') AND NOT", "the ", "@")
_PLANTED_SQL = ", ".join("('" + c.replace("'", "''") + "')" for c in _PLANTED)


@query(
    "SELECT lang AS surface, canary, count(*) AS rows FROM documents JOIN "
    f"(VALUES {_PLANTED_SQL}) c(canary) ON contains(text, canary) GROUP BY lang, canary"
)
def value_leaks(spark, sf):
    return quality.leaks(table(spark, sf, "corpus.documents"), "lang", "text", _PLANTED)
