from __future__ import annotations

from datetime import UTC, datetime

import pytest

from tabulary.desk import QueryDesk
from tabulary.errors import ERROR_CODES, QueryError
from tabulary.operators import discovery, projection
from tabulary.plans.legal_corpus import NEWSROOMS, legal_registry
from tabulary.registry import DatabaseSpec, Registry, TableSpec

AT = datetime(2026, 5, 17, 10, 0, tzinfo=UTC)
JUDGMENT_COLUMNS = (
    "id string, citation string, case_name string, case_numbers string, decision_date string, "
    "court string, subject_tags string, source_url string, pdf_url string, content_text string, "
    "court_summary string, summary string, created_at string"
)
FRAGMENT_COLUMNS = (
    "id string, judgment_id string, ordinal int, paragraph_number int, class_name string, "
    "section_heading string, content_text string, html_raw string, footnote_text string"
)
NEWS_COLUMNS = (
    "id string, source_url string, category string, title string, published_date string, "
    "content_text string, summary string, created_at string"
)


def judgment(i, url, created, court="SGHC"):
    return (
        f"j{i}", f"[2026] {court} {i}", f"A v B {i}", "HC/1", f"2026-01-{i:02}", court, None, url,
        None, f"long text {i}", None, f"summary {i}", created,
    )


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("legal")

    def write(database, table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{database}/{table}.parquet")

    write(
        "judgements", "judgments",
        [
            judgment(1, "https://e.sg/1", "2026-02-01"),
            judgment(2, "https://e.sg/2", "2026-02-01"),
            judgment(3, "https://e.sg/2", "2026-02-09", "SGCA"),
        ],
        JUDGMENT_COLUMNS,
    )
    write(
        "judgements", "judgments_fragments",
        [
            (f"j{j}_{n:04}", f"j{j}", n, n, "para", None, f"paragraph {n} of {j}", "<p>", None)
            for j in (1, 2, 3)
            for n in range(250, 0, -1)
        ],
        FRAGMENT_COLUMNS,
    )
    write(
        "sg-gov-newsrooms", "acra_news",
        [("n1", "https://n/1", "speech", "Data protection day", "2026-01-01", "body", "s", "x")],
        NEWS_COLUMNS,
    )
    return str(folder)


@pytest.fixture(scope="module")
def desk(spark, base):
    return QueryDesk(spark, legal_registry(source="src", attribution="who"), base, clock=lambda: AT)


def code(call, *args, **kwargs):
    with pytest.raises(QueryError) as error:
        call(*args, **kwargs)
    return error.value.code


def test_default_columns_are_light_with_a_citation(desk):
    answer = desk.query_table("judgements", "judgments")
    assert answer.data.columns == [
        "citation", "case_name", "case_numbers", "decision_date", "court", "subject_tags",
        "source_url", "pdf_url", "summary", "_citation",
    ]
    assert answer.data.first()["_citation"] == (
        "A v B 1 [2026] SGHC 1 (SGHC, 2026-01-01) — https://e.sg/1"
    )
    p = answer.provenance
    assert (p.source, p.database, p.table, p.license, p.attribution) == (
        "src", "judgements", "judgments", "CC-BY-4.0", "who",
    )
    assert p.retrieved_at == AT


def test_heavy_text_is_nested_with_its_terms(desk):
    answer = desk.query_table("judgements", "judgments", columns=["content_text", "court"])
    assert answer.data.columns == ["court", "retrieved_content", "_citation"]
    row = answer.data.first()
    assert set(row["retrieved_content"].asDict()) == {"content_text", "_policy"}
    assert row["retrieved_content"]["content_text"] == "long text 1"
    assert row["retrieved_content"]["_policy"].asDict() == {
        "source": "Singapore Supreme Court / Crown Copyright Singapore",
        "license": "Crown Copyright Singapore",
        "license_url": "https://www.elitigation.sg/",
        "redistribution": "process-only",
    }
    assert row["_citation"].startswith("A v B 1 [2026] SGHC 1")


def test_heavy_columns_are_not_read_unless_asked_for(desk):
    plan = desk.query_table("judgements", "judgments").data._jdf.queryExecution()
    assert "content_text" not in plan.executedPlan().toString()


def test_filters_sort_and_pages(desk):
    first = desk.query_table("judgements", "judgments", sort="-decision_date", limit=2)
    assert [r["citation"] for r in first.data.collect()] == ["[2026] SGCA 3", "[2026] SGHC 2"]
    page = first.pagination()
    assert page.truncated and page.next_position[0] == "2026-01-02"
    assert "j2" not in str(page.next_position)
    second = desk.query_table(
        "judgements", "judgments", sort="-decision_date", limit=2, position=page.next_position
    )
    assert [r["citation"] for r in second.data.collect()] == ["[2026] SGHC 1"]
    assert second.pagination().next_position is None
    as_json = desk.query_table(
        "judgements", "judgments", columns='["court"]',
        filters='[{"column": "court", "op": "exact", "value": "SGCA"}]',
    )
    assert [r["court"] for r in as_json.data.collect()] == ["SGCA"]
    assert desk.count_rows("judgements", "judgments", [{"column": "court", "op": "not", "value": "SGCA"}]) == 2


def url_filter(url):
    return {"column": "source_url", "op": "exact", "value": url}


def test_fragment_walk_in_pages(desk):
    seen, position = [], None
    while True:
        answer = desk.query_table(
            "judgements", "judgments_fragments", filters=[url_filter("https://e.sg/2")],
            columns=["ordinal", "content_text"], limit=100, position=position,
        )
        seen += [(r["ordinal"], r["retrieved_content"]["content_text"]) for r in answer.data.collect()]
        position = answer.pagination().next_position
        if position is None:
            break
        assert not any("j2" in str(v) for v in position)
    assert seen == [(n, f"paragraph {n} of 3") for n in range(1, 251)]
    assert not {"id", "judgment_id", "source_url"} & set(answer.data.columns)


def test_fragment_filters_combine(desk):
    got = desk.query_table(
        "judgements", "judgments_fragments",
        filters=[url_filter("https://e.sg/1"), {"column": "ordinal", "op": "lte", "value": 2}],
    )
    assert [r["ordinal"] for r in got.data.collect()] == [1, 2]


def test_an_unknown_parent_gives_no_rows_not_all_rows(desk):
    got = desk.query_table("judgements", "judgments_fragments", filters=[url_filter("https://no")])
    assert got.data.count() == 0


def test_fragment_limit_is_lower(desk):
    assert code(
        desk.query_table, "judgements", "judgments_fragments",
        filters=[url_filter("https://e.sg/1")], limit=101,
    ) == "invalid_filter_op"


def test_fetch(desk):
    got = desk.fetch("judgements", "judgments", "https://e.sg/1")
    row = got.data.first().asDict()
    assert list(row)[:-1] == sorted(list(row)[:-1]) and got.warnings == ()
    assert row["citation"] == "[2026] SGHC 1" and "content_text" not in row and "id" not in row
    twice = desk.fetch("judgements", "judgments", "https://e.sg/2")
    assert twice.data.first()["citation"] == "[2026] SGHC 2"
    assert twice.warnings == ("ambiguous_url: match_count=2",)
    assert code(desk.fetch, "judgements", "judgments", "https://e.sg/1/") == "not_found"
    assert code(desk.fetch, "judgements", "judgments_fragments", "x") == "unsupported_table_for_fetch"


def test_errors_do_not_echo_values(desk):
    canary = "CANARY_42"
    calls = [
        (desk.fetch, ("judgements", "judgments", canary), {}),
        (desk.query_table, ("judgements", "judgments_fragments"),
         {"filters": [{"column": "ordinal", "op": "gt", "value": canary}]}),
        (desk.query_table, ("judgements", "judgments"),
         {"filters": [{"column": "court", "op": "in", "value": canary}]}),
        (desk.query_table, ("judgements", "judgments"), {"position": (canary,), "sort": "court"}),
    ]
    for call, args, kwargs in calls:
        with pytest.raises(QueryError) as error:
            call(*args, **kwargs).data.count()
        assert canary not in str(error.value) and error.value.__cause__ is None


@pytest.mark.parametrize("name", ["id", "no_such_column"])
def test_hidden_and_missing_columns_fail_alike(desk, name):
    clause = {"column": name, "op": "exact", "value": 1}
    for kwargs in ({"filters": [clause]}, {"sort": f"-{name}"}, {"columns": [name]}):
        with pytest.raises(QueryError) as error:
            desk.query_table("judgements", "judgments", **kwargs)
        assert str(error.value) == f"unknown_column: Column not found: judgements.judgments.{name}"


def test_hidden_and_missing_tables_fail_alike(spark):
    registry = Registry(
        [
            DatabaseSpec(
                "db",
                (TableSpec("open", key=("n",)), TableSpec("shut", key=("n",), hidden=True),
                 TableSpec("denied", key=("n",))),
                denied_tables=frozenset({"denied"}),
            )
        ]
    )
    desk = QueryDesk(spark, registry, open_table=lambda d, t: spark.range(1).toDF("n"))
    for table in ("shut", "denied", "missing"):
        for call in (desk.query_table, desk.describe_table):
            with pytest.raises(QueryError) as error:
                call("db", table)
            assert str(error.value) == f"unknown_table: Table not found: db.{table}"
    assert code(desk.list_tables, "nope") == "unknown_database"
    assert [r["name"] for r in desk.list_tables("db").data.collect()] == ["open"]
    assert desk.list_databases().data.first()["table_count"] == 1


def test_describe_table(desk):
    row = desk.describe_table("judgements", "judgments_fragments", {"ordinal": "NUMERIC"}).data.first()
    assert list(row.asDict()) == [
        "name", "columns", "light_columns", "available_columns", "url_keyed",
        "supports_fragments", "row_count", "description",
    ]
    types = {c["name"]: c["type"] for c in row["columns"]}
    assert types["ordinal"] == "NUMERIC" and types["paragraph_number"] == "INTEGER"
    assert types["content_text"] == "TEXT" and "id" not in types and "judgment_id" not in types
    assert row["light_columns"] == ["ordinal", "paragraph_number", "class_name", "section_heading"]
    assert (row["url_keyed"], row["supports_fragments"], row["row_count"]) == (False, True, 750)
    assert row["description"].startswith("Judgments cut")


def test_both_sides_of_a_pair_support_fragments():
    registry = legal_registry("courts")
    assert registry.supports_fragments("courts", "judgments")
    assert registry.supports_fragments("courts", "judgments_fragments")
    assert not registry.supports_fragments("sglawwatch", "headlines")


def test_list_databases(desk):
    rows = {r["name"]: r for r in desk.list_databases().data.collect()}
    assert {n: r["table_count"] for n, r in rows.items()} == {
        "judgements": 2, "pdpc": 2, "sg-gov-newsrooms": 8, "sglawwatch": 4,
    }
    assert rows["pdpc"]["license"] == "CC-BY-4.0"


def test_newsrooms_follow_one_rule():
    registry = legal_registry()
    tables = {t.name: t for t in registry.visible_tables("sg-gov-newsrooms")}
    assert list(tables) == [f"{p}_news" for p in NEWSROOMS]
    assert tables["mom_news"].citation == "{title} ({category}, {published_date}) — {source_url}"
    assert tables["judiciary_news"].citation.startswith("{title} ({content_type}, ")
    assert tables["judiciary_news"].light[2:4] == ("content_type", "courts")


def test_license_pair_is_chosen_as_a_pair():
    both = DatabaseSpec("d", (), license="own", license_url="u", upstream_license="up")
    assert both.license_pair() == ("up", None)
    assert DatabaseSpec("d", (), license="own", license_url="").license_pair() == ("own", None)
    assert DatabaseSpec("d", ()).license_pair() == ("", None)


def test_citations_render_nulls_and_gaps_as_nothing(spark):
    df = spark.createDataFrame([(None, 5)], "a string, retrieved_at int")
    template = "{a}|{missing}|{retrieved_at}"
    cite = projection.citation(template, df.columns, AT)
    assert df.select(cite).first()[0] == f"||{AT.isoformat()}"
    assert projection.template_columns(template) == ["a", "missing"]


def test_light_columns_never_include_heavy_or_hidden_ones(spark):
    spec = TableSpec("t", key=("n",), light=("text", "secret", "gone", "a"), hidden_columns=frozenset({"secret"}))
    registry = Registry([DatabaseSpec("d", (spec,))], heavy=["text"])
    df = spark.createDataFrame([(1, "x", "y", "z")], "n int, text string, secret string, a string")
    assert projection.default_light(registry, spec, df) == ["a"]
    plain = TableSpec("t", key=("n",), hidden_columns=frozenset({"secret"}))
    assert projection.default_light(registry, plain, df) == ["a", "n"]


def test_descriptions_fall_back(spark):
    df = spark.createDataFrame([("", "cfg"), (None, "cfg"), ("up", "cfg"), (None, None)], "u string, f string")
    got = [r[0] for r in df.select(discovery.described(df["u"], df["f"])).collect()]
    assert got == ["cfg", "cfg", "up", ""]


def test_error_codes_are_fixed():
    assert len(ERROR_CODES) == 11
    with pytest.raises(ValueError):
        QueryError("oops", "x")


def test_totals_on_the_page(desk):
    answer = desk.query_table(
        "judgements", "judgments_fragments", [url_filter("https://e.sg/2")], limit=10, with_total=True
    )
    assert answer.pagination().total == 250
    assert desk.query_table("judgements", "judgments").pagination().total is None


def test_positions_of_another_request_are_refused(desk):
    position = desk.query_table("judgements", "judgments", limit=1).pagination().next_position
    assert desk.query_table("judgements", "judgments", limit=1, position=position).data.count() == 1
    for wrong in (("0" * 64,), (), ("a", "b"), ("j1",)):
        with pytest.raises(QueryError) as error:
            desk.query_table("judgements", "judgments", position=wrong)
        assert error.value.code == "invalid_cursor"
