"""Phrase search, previews, merge and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.operators import merge, postings, search
from tabulary.plans.bindings import CC_BY, REGISTRY, RETRIEVED_AT, RETRIEVED_TEXT
from tabulary.plans.catalogue import desk, query, table
from tabulary.session import local_frame

_ODC = "https://opendatacommons.org/licenses/by/1-0/"
_WORDS = "(' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"


def _holds(column: str, phrase: str) -> str:
    return f"contains({_WORDS.format(column)}, ' {phrase} ')"


def _opener(spark, sf):
    return lambda database, spec: table(spark, sf, f"{database}.{spec.name}")


def _tables(spark, sf):
    open_table = _opener(spark, sf)
    found = search.targets(REGISTRY, list(REGISTRY.databases), open_table)
    return [(t, open_table(t.database, t.spec)) for t in found]


#: Preview rows per searchable table in turn order, spelled for the oracles:
#: (label, title, url, citation, order, searched column, license, license url)
_PREVIEWS = {
    "pages": (
        "corpus", "url", "url", f"url || ' (retrieved {RETRIEVED_TEXT})'", "page_id", "url",
    ),
    "documents": (
        "corpus", "source || ' ' || lang", "'row://documents/' || doc_id",
        f"source || '/' || doc_id || ' (' || lang || '), retrieved {RETRIEVED_TEXT}'",
        "n_chars DESC, doc_id", "text",
    ),
    "conversations": (
        "corpus", "'Dialogue ' || conv_id",
        "'row://conversations/' || conv_id || '/' || turn",
        "'Dialogue ' || conv_id || ', turn ' || turn", "conv_id, turn", "text",
    ),
    "benchmark": (
        "corpus", "'Item ' || item_id", "'row://benchmark/' || item_id",
        f"'row://benchmark/' || item_id || ' (retrieved {RETRIEVED_TEXT})'", "item_id", "text",
    ),
    "part": (
        "sales", "p_name", "'row://part/' || p_partkey",
        "p_name || ' (' || p_brand || ') row://part/' || p_partkey",
        "p_name NULLS FIRST, p_partkey", "p_name",
    ),
}
_TURNS = ("documents", "pages", "conversations", "benchmark", "part")
_TERMS = {"corpus": ("ODC-BY", _ODC), "sales": ("CC-BY-4.0", CC_BY)}


def _preview_sql(name: str, phrase: str | None, extra: str = "") -> str:
    database, title, url, cite, order, column = _PREVIEWS[name]
    text, link = _TERMS[database]
    where = f" WHERE {_holds(column, phrase)}" if phrase else ""
    rank = f", row_number() OVER (ORDER BY {order}) AS round" if extra else ""
    return (
        f"SELECT {title} AS title, CAST(NULL AS VARCHAR) AS date, "
        f"CAST(NULL AS VARCHAR) AS summary, {url} AS url, '{database}' AS database, "
        f"'{name}' AS \"table\", '{text}' AS license, '{link}' AS license_url, "
        f"{cite} AS _citation{rank}{extra} FROM {name}{where}"
    )


def _merged_sql(phrase: str, limit: int, names=_TURNS) -> str:
    parts = [_preview_sql(n, phrase, f", {i} AS turn") for i, n in enumerate(names)]
    return (
        "SELECT title, date, summary, url, database, \"table\", license, license_url, _citation "
        f"FROM ({' UNION ALL '.join(parts)}) WHERE round <= {limit} "
        f"ORDER BY round, turn LIMIT {limit}"
    )


def _hits_sql(name: str, phrase: str) -> str:
    database, *_, column = _PREVIEWS[name]
    return f"SELECT '{database}.{name}' AS label, count(*) AS hits FROM {name} WHERE {_holds(column, phrase)}"


@query(_merged_sql("of the", 100))
def search_merged(spark, sf):
    return desk(spark, sf).search("of the", limit=100).data


@query(
    f"SELECT m.*, t.hits AS table_hits FROM ({_merged_sql('of the', 100)}) m "
    f"JOIN ({' UNION ALL '.join(_hits_sql(n, 'of the') for n in _TURNS)}) t ON m.database || '.' || m.\"table\" = t.label"
)
def search_at_once(spark, sf):
    """The merged rows, each with all hits of its table, from one job."""
    rows, page = desk(spark, sf).search("of the", limit=100).at_once()
    totals = local_frame(spark, list(page.upstream_total_hits.items()), "label string, table_hits long")
    same = F.concat_ws(".", "database", "table") == F.col("label")
    return rows.join(F.broadcast(totals), same).drop("label")  # one row per table


@query(_merged_sql("widget", 20, ("part",)))
def search_one_database(spark, sf):
    return desk(spark, sf).search(' "Widget" ', databases=["sales"], limit=20).data


def _totals_sql(phrase: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{_PREVIEWS[n][0]}.{n}' AS \"table\", count(*) AS hits FROM {n} "
        f"WHERE {_holds(_PREVIEWS[n][5], phrase)}"
        for n in _TURNS
    )


@query(_totals_sql("of the"))
def search_totals(spark, sf):
    return search.search_totals(search.find_hits(REGISTRY, _tables(spark, sf), "of the"))


@query(_totals_sql("of the"))
def search_totals_from_map(spark, sf):
    totals = search.totals_map(search_totals(spark, sf))
    return totals.select(F.explode("upstream_total_hits").alias("table", "hits"))


@query(f"SELECT doc_id, lang, n_chars FROM documents WHERE {_holds('text', 'and the')}")
def phrase_hits(spark, sf):
    rows = table(spark, sf, "corpus.documents")
    target = next(t for t, _ in _tables(spark, sf) if t.spec.name == "documents")
    return search.hits(target, rows, "And -- (THE)").select("doc_id", "lang", "n_chars")


@query(
    "SELECT p_partkey, p_name, p_type FROM part "
    f"WHERE {_holds('p_name', 'small')} OR {_holds('p_type', 'small')}"
)
def phrase_in_any_column(spark, sf):
    part = table(spark, sf, "sales.part")
    found = part.filter(
        search.matches_phrase_in_any([F.col("p_name"), F.col("p_type")], "small")
    )
    return found.select("p_partkey", "p_name", "p_type")


@query(
    " UNION ALL ".join(
        f"SELECT '{_PREVIEWS[n][0]}' AS database, '{n}' AS \"table\", {i} AS turn, "
        f"'{title}' AS title_column, 'url' AS url_column, count(*) AS row_count FROM {n}"
        for i, (n, title) in enumerate(zip(_TURNS, ["title"] * 5, strict=True))
    )
)
def searchable_tables(spark, sf):
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(t.database).alias("database"),
            F.lit(t.spec.name).alias("table"),
            F.lit(t.turn).alias("turn"),
            F.lit(t.preview["title"]).alias("title_column"),
            F.lit(t.preview["url"]).alias("url_column"),
            "row_count",
        )
        for t, df in _tables(spark, sf)
    ]
    return reduce(DataFrame.unionByName, parts)


def _all_previews(spark, sf):
    parts = [
        df.select(*search.preview_columns(REGISTRY, t, df, RETRIEVED_AT))
        for t, df in _tables(spark, sf)
    ]
    return reduce(DataFrame.unionByName, parts)


@query(" UNION ALL ".join(_preview_sql(n, None) for n in _TURNS))
def preview_union(spark, sf):
    return _all_previews(spark, sf)


@query(" UNION ALL ".join(_preview_sql(n, None) for n in _TURNS if n != "conversations"))
def previews_of_visible_tables(spark, sf):
    """Rows of a table that the catalog does not list are dropped."""
    rows = _all_previews(spark, sf)
    gone = F.when(F.col("table") == "conversations", "labels").otherwise(F.col("table"))
    return search.visible_only(REGISTRY, rows.withColumn("table", gone))


@query(
    "SELECT lang, doc_id, n_chars, CAST(round AS INTEGER) AS round FROM (SELECT lang, doc_id, n_chars, row_number() OVER "
    "(PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS round FROM documents) WHERE round <= 20"
)
def first_rows_per_group(spark, sf):
    docs = table(spark, sf, "corpus.documents").select("lang", "doc_id", "n_chars")
    order = [F.col("n_chars").desc(), F.col("doc_id").asc()]
    return merge.first_per_group(docs, ["lang"], order, 20)


@query(
    "SELECT o_orderstatus, o_orderkey, CAST(round AS INTEGER) AS round FROM (SELECT o_orderstatus, o_orderkey, "
    "row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) "
    "AS round FROM orders) WHERE round <= 1500"
)
def many_rows_per_group(spark, sf):
    orders = table(spark, sf, "sales.orders")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    first = merge.first_per_group(
        orders.select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], order, 1500
    )
    return first.select("o_orderstatus", "o_orderkey", "round")


def _sentences(spark, sf):
    """All sentences of every benchmark item, as phrases to look for."""
    items = table(spark, sf, "corpus.benchmark")
    sentences = F.regexp_extract_all("text", F.lit("[^.!?]+"), F.lit(0))
    listed = items.select("item_id", F.posexplode(sentences).alias("at", "phrase"))
    return listed.select((F.col("item_id") * 10_000 + F.col("at")).alias("query_id"), "phrase")


#: Every searchable table.
_SEARCHED = ("corpus.documents", "corpus.conversations", "corpus.benchmark", "corpus.pages", "sales.part")


def _texts(spark, sf):
    parts = []
    for name in _SEARCHED:
        database, short = name.split(".")
        spec = REGISTRY.any_table(database, short)
        parts.append(postings.texts(table(spark, sf, name), name, spec.key, spec.search_columns))
    return reduce(DataFrame.unionByName, parts)


_SENTENCES = (
    "(SELECT item_id * 10000 + pos - 1 AS query_id, trim(regexp_replace(lower(sentence), "
    "'[^\\p{L}\\p{N}]+', ' ', 'g')) AS phrase FROM (SELECT item_id, "
    "unnest(regexp_extract_all(text, '[^.!?]+')) AS sentence, "
    "generate_subscripts(regexp_extract_all(text, '[^.!?]+'), 1) AS pos FROM benchmark))"
)
_CORPUS_TEXT = (
    "(SELECT 'corpus.documents' AS \"table\", CAST(doc_id AS VARCHAR) AS row_key, text "
    "FROM documents UNION ALL SELECT 'corpus.conversations', conv_id || '/' || turn, text "
    "FROM conversations UNION ALL SELECT 'corpus.benchmark', CAST(item_id AS VARCHAR), text "
    "FROM benchmark UNION ALL SELECT 'corpus.pages', CAST(page_id AS VARCHAR), url FROM pages "
    "UNION ALL SELECT 'sales.part', CAST(p_partkey AS VARCHAR), p_name FROM part)"
)
_MANY = (
    f"SELECT query_id, \"table\", row_key FROM {_SENTENCES} q JOIN "
    f"(SELECT \"table\", row_key, {_WORDS.format('text')} AS words FROM {_CORPUS_TEXT}) t "
    "ON q.phrase <> '' AND contains(t.words, ' ' || q.phrase || ' ')"
)


@query(_MANY)
def many_phrases(spark, sf):
    return postings.match_phrases(_texts(spark, sf), _sentences(spark, sf))


@query(_MANY)
def many_phrases_by_postings(spark, sf):
    """The same with both joins by shuffles, as for very many phrases."""
    return postings.match_phrases(_texts(spark, sf), _sentences(spark, sf), broadcast=False)


@query(
    "SELECT q.query_id, l.\"table\", count(m.row_key) AS hits FROM "
    f"{_SENTENCES} q CROSS JOIN (VALUES {', '.join(f'({n!r})' for n in _SEARCHED)}) "
    f"l(\"table\") LEFT JOIN ({_MANY}) m "
    "ON m.query_id = q.query_id AND m.\"table\" = l.\"table\" GROUP BY 1, 2"
)
def many_phrase_totals(spark, sf):
    queries = _sentences(spark, sf)
    matches = postings.match_phrases(_texts(spark, sf), queries)
    return postings.hit_totals(matches, queries, _SEARCHED)
