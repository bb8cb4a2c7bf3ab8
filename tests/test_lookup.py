from __future__ import annotations

import pytest

from tabulary.errors import QueryError
from tabulary.operators import fragments, lookup
from tabulary.operators.filters import Clause
from tabulary.registry import DatabaseSpec, FragmentLink, Registry, TableSpec

LINK = FragmentLink("docs", "doc_id", "id", "ordinal", "created_at")
REGISTRY = Registry(
    [
        DatabaseSpec(
            "db",
            (
                TableSpec("docs", key=("id",), url_column="url"),
                TableSpec("parts", key=("part_id",), link=LINK),
                TableSpec("plain", key=("id",)),
            ),
        )
    ]
)
DOCS = [
    ("d1", "https://a.b/1", "2024-01-01"),
    ("d2", "https://a.b/1", "2024-03-01"),
    ("d3", "https://a.b/1", None),
    ("d4", "http://A.b/2/", "2024-01-01"),
    ("d5", "https://a.b/2", "2024-01-01"),
]
PARTS = [(f"{d}_{n}", d, n, f"text {d} {n}") for d in ("d1", "d2", "d4", "d5") for n in (3, 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, url string, created_at string")


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(PARTS, "part_id string, doc_id string, ordinal int, body string")


def requests(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_fetch_many_counts_and_takes_the_first(spark, docs):
    wanted = requests(spark, "https://a.b/1", "https://a.b/1", "https://a.b/9", "https://a.b/2")
    got = lookup.fetch_many(docs, "url", ["id"], ["id", "created_at"], wanted)
    assert sorted(map(tuple, got.collect())) == [
        ("https://a.b/1", 3, "d1", "2024-01-01"),
        ("https://a.b/2", 1, "d5", "2024-01-01"),
        ("https://a.b/9", 0, None, None),
    ]
    assert lookup.ambiguous(got).collect() == [("https://a.b/1", 3)]
    assert [r[0] for r in lookup.not_found(docs, "url", wanted).collect()] == ["https://a.b/9"]


def test_normalized_match(spark, docs):
    wanted = requests(spark, "HTTPS://a.B/2/")
    raw = lookup.fetch_many(docs, "url", ["id"], ["id"], wanted).first()
    loose = lookup.fetch_many(docs, "url", ["id"], ["id"], wanted, "normalized").first()
    assert raw["match_count"] == 0
    assert (loose["match_count"], loose["id"]) == (2, "d4")
    assert lookup.not_found(docs, "url", wanted).count() == 1
    assert lookup.not_found(docs, "url", wanted, "normalized").count() == 0


def test_matches_are_reduced_before_the_shuffle(spark, docs):
    plan = lookup.fetch_many(docs, "url", ["id"], ["id"], requests(spark, "x"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in text or "partial_minby" in text


def test_tables_without_a_key_cannot_be_fetched():
    with pytest.raises(QueryError) as error:
        lookup.url_key("db", REGISTRY.resolve("db", "plain"))
    assert error.value.code == "unsupported_table_for_fetch"


def clause(op="exact", value="https://a.b/1", column="url"):
    return Clause(column, op, value)


def test_one_exact_filter_on_the_parent_key_joins():
    spec = REGISTRY.resolve("db", "parts")
    other = clause("gte", 2, "ordinal")
    assert fragments.split_trigger(REGISTRY, "db", spec, [other, clause()]) == (clause(), [other])


@pytest.mark.parametrize("clauses", [[], [clause("contains")], [clause(), clause(value="x")]])
def test_anything_else_does_not(clauses):
    spec = REGISTRY.resolve("db", "parts")
    assert fragments.split_trigger(REGISTRY, "db", spec, clauses) == (None, clauses)
    plain = REGISTRY.resolve("db", "docs")
    assert fragments.split_trigger(REGISTRY, "db", plain, [clause()]) == (None, [clause()])


def test_the_latest_parent_wins(docs, parts):
    got = fragments.fragments_of(parts, docs, "url", LINK, ["id"], "https://a.b/1")
    assert {r["doc_id"] for r in got.collect()} == {"d2"}
    tie = fragments.latest_parent(
        docs.withColumnRenamed("url", "u").withColumn("url", docs["created_at"]),
        "url", LINK, ["id"], "2024-01-01",
    )
    assert tie.first()["id"] == "d5"


def test_an_unknown_parent_has_no_fragments(spark, docs, parts):
    assert fragments.fragments_of(parts, docs, "url", LINK, ["id"], "https://a.b/9").count() == 0
    wanted = requests(spark, "https://a.b/9", "https://a.b/2")
    got = fragments.unknown_parents(docs, "url", wanted)
    assert [r[0] for r in got.collect()] == ["https://a.b/9"]


def test_many_parents_with_positions(spark, docs, parts):
    wanted = requests(spark, "https://a.b/1", "https://a.b/2", "https://a.b/9")
    got = fragments.walk(parts, docs, "url", LINK, ["id"], ["part_id"], wanted)
    rows = sorted((r["parent_url"], r["position"], r["part_id"]) for r in got.collect())
    assert rows == [
        ("https://a.b/1", 1, "d2_1"), ("https://a.b/1", 2, "d2_2"), ("https://a.b/1", 3, "d2_3"),
        ("https://a.b/2", 1, "d5_1"), ("https://a.b/2", 2, "d5_2"), ("https://a.b/2", 3, "d5_3"),
    ]


def test_two_spellings_of_one_url_both_get_its_fragments(spark, docs, parts):
    wanted = requests(spark, "https://a.b/2/", "http://a.b/2")
    got = fragments.fragments_of_many(
        parts, docs, "url", LINK, ["id"], wanted, match="normalized"
    ).collect()
    assert len(got) == 6 and {r["doc_id"] for r in got} == {"d5"}


def test_duplicate_report_hides_the_url(docs):
    (row,) = fragments.multi_match_report(docs, "url", LINK).collect()
    assert (row["parent_match_count"], row["selected_parent_match_value"]) == (3, "2024-03-01")
    assert "a.b" not in str(row)


def test_the_parent_key_reaches_the_fragment_scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    link = FragmentLink("orders", "l_orderkey", "o_orderkey", "l_linenumber", "o_orderdate")
    got = fragments.fragments_of(lines, orders, "o_custkey", link, ["o_orderkey"], 1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = got.select("l_orderkey", "l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,ScalarSubquery" in plan
