from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tabulary.desk import QueryDesk
from tabulary.errors import QueryError
from tabulary.functions.text import phrase_tokens
from tabulary.operators import merge, postings, search
from tabulary.registry import DatabaseSpec, Registry, TableSpec

HEAVY = frozenset({"content_text", "text"})


def test_preview_takes_the_first_candidate():
    columns = ["citation", "case_name", "decision_date", "source_url", "summary", "content_text"]
    assert search.resolve_preview(columns, HEAVY) == {
        "title": "case_name", "date": "decision_date", "summary": "summary", "url": "source_url",
    }


def test_preview_without_a_date_is_null():
    got = search.resolve_preview(["item_url", "title", "section", "home_page"], HEAVY)
    assert got == {"title": "title", "date": None, "summary": "section", "url": "item_url"}


def test_preview_needs_title_and_url():
    assert search.resolve_preview(["title"], HEAVY) is None
    assert search.resolve_preview(["source_url"], HEAVY) is None


def test_preview_override_suppresses_a_field():
    got = search.resolve_preview(["title", "decision_date", "source_url"], HEAVY, {"date": None})
    assert got["date"] is None and got["title"] == "title"


def test_heavy_columns_never_preview():
    candidates = {**search.PREVIEW_CANDIDATES, "title": ("content_text", "title")}
    got = search.resolve_preview(["content_text", "title", "source_url"], HEAVY, None, candidates)
    assert got["title"] == "title"


@pytest.mark.parametrize(
    ("tables", "expected"),
    [
        (["A1 A2 A3", "B1 B2 B3"], "A1 B1 A2 B2 A3 B3"),
        (["A1", "B1 B2 B3"], "A1 B1 B2 B3"),
        (["", "B1"], "B1"),
    ],
)
def test_round_robin(spark, tables, expected):
    rows = [
        (name, round_, turn)
        for turn, names in enumerate(tables)
        for round_, name in enumerate(names.split(), start=1)
    ]
    df = spark.createDataFrame(rows, "name string, round int, turn int")
    got = [r["name"] for r in merge.round_robin(df, 100).collect()]
    assert got == expected.split()
    assert [r["name"] for r in merge.round_robin(df, 2).collect()] == got[:2]


def news(name, **kw):
    return TableSpec(
        name, key=("id",), search_columns=("title", "summary"), default_sort="-published_date",
        citation="{title} ({published_date}) — {source_url}", **kw,
    )


REGISTRY = Registry(
    [
        DatabaseSpec("zeta", (news("z_news"),), license="Z", license_url="https://z"),
        DatabaseSpec(
            "alpha",
            (
                news("b_news"),
                news("a_news"),
                news("hidden_news", hidden=True),
                news("a_fragments"),
                TableSpec("unindexed", key=("id",)),
                TableSpec("untitled", key=("id",), search_columns=("body",)),
            ),
        ),
        DatabaseSpec("empty", (TableSpec("unindexed", key=("id",)),)),
    ],
    heavy=("content_text",),
    hidden_columns=("id",),
)
AT = datetime(2026, 5, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def desk(spark):
    schema = "id int, title string, published_date string, summary string, source_url string"

    def rows(name, hits, misses):
        found = [(i, f"Data protection {name}{i}", f"2024-01-{i:02}", None, f"u/{name}{i}") for i in range(1, hits + 1)]
        other = [(100 + i, f"Other {name}", "2025-01-01", "data, then protection", f"u/o{i}") for i in range(misses)]
        return spark.createDataFrame(found + other, schema)

    frames = {
        "z_news": rows("z", 3, 1),
        "b_news": rows("b", 1, 2),
        "a_news": rows("a", 0, 1),
        "hidden_news": rows("h", 5, 0),
        "a_fragments": rows("f", 5, 0),
        "unindexed": rows("u", 5, 0),
        "untitled": spark.createDataFrame([(1, "data protection")], "id int, body string"),
    }
    return QueryDesk(spark, REGISTRY, open_table=lambda d, t: frames[t.name], clock=lambda: AT)


def test_search_merges_in_turn(desk):
    answer = desk.search("data protection", limit=3)
    rows = answer.data.collect()
    assert [r["title"].split()[-1] for r in rows] == ["b1", "z3", "z2"]
    assert answer.data.columns == [
        "title", "date", "summary", "url", "database", "table", "license", "license_url", "_citation",
    ]
    assert (rows[1]["license"], rows[1]["license_url"], rows[0]["license_url"]) == ("Z", "https://z", None)
    assert rows[0]["_citation"] == "Data protection b1 (2024-01-01) — u/b1"
    assert (answer.provenance.license, answer.provenance.license_url) == ("mixed", None)


def test_totals_count_every_hit_and_every_table(desk):
    totals = desk.search("data protection", limit=1).pagination().upstream_total_hits
    assert totals == {"alpha.b_news": 1, "alpha.a_news": 0, "zeta.z_news": 3}


def test_kept_hits_give_the_same_answer(desk):
    plain = desk.search("data protection", limit=4)
    kept = desk.search("data protection", limit=4, keep_hits=True)
    assert kept.data.collect() == plain.data.collect()
    totals = kept.pagination().upstream_total_hits
    assert totals == plain.pagination().upstream_total_hits
    plan = kept.data._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    desk.spark.catalog.clearCache()


@pytest.mark.parametrize("phrase", ["data protection", "protection", "nowhere to be found"])
def test_rows_and_totals_at_once(desk, phrase):
    answer = desk.search(phrase, limit=2)
    rows, page = answer.at_once()
    assert rows.collect() == answer.data.collect() and rows.schema.names == answer.data.schema.names
    assert page.upstream_total_hits == answer.pagination().upstream_total_hits
    nothing, none = desk.search("x", databases=["empty"]).at_once()
    assert nothing.count() == 0 and none.upstream_total_hits == {}


def test_at_once_runs_one_query(desk, monkeypatch):
    """One collect, whose plan scans every searched table once."""
    plans, collect = [], type(desk.search("x").data).collect

    def counted(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return collect(self)

    answer = desk.search("data protection", limit=2)
    monkeypatch.setattr(type(answer.data), "collect", counted)
    answer.at_once()
    assert len(plans) == 1 and plans[0].count("CollectMetrics") == 3
    assert plans[0].count("Relation") + plans[0].count("LogicalRDD") + plans[0].count("LocalRelation") <= 5


@pytest.mark.parametrize("setting", ["spark.sql.execution.arrow.pyspark.enabled", "spark.sql.execution.topKSortFallbackThreshold"])
def test_totals_at_once_where_parts_are_dropped_or_computed_twice(desk, setting):
    """Stages below the merge: adaptive execution drops empty ones, and range sorts sample theirs first."""
    spark, before = desk.spark, desk.spark.conf.get(setting)
    spark.conf.set(setting, "1" if before.isdigit() else "false")
    try:
        for phrase in ("data protection", "nowhere to be found"):
            answer = desk.search(phrase, limit=2)
            rows, page = answer.at_once()
            assert page.upstream_total_hits == answer.pagination().upstream_total_hits
            assert rows.collect() == answer.data.collect()
    finally:
        spark.conf.set(setting, before)


def test_a_phrase_may_stand_in_any_search_column_but_not_across(desk):
    totals = desk.search("then protection").pagination().upstream_total_hits
    assert totals == {"alpha.b_news": 2, "alpha.a_news": 1, "zeta.z_news": 1}


def test_nothing_searchable_is_an_empty_answer(desk):
    answer = desk.search("x", databases=["empty"])
    assert answer.data.count() == 0 and len(answer.data.columns) == 9
    assert answer.pagination().upstream_total_hits == {}


def test_no_hits(desk):
    assert desk.search("nowhere to be found").data.count() == 0


@pytest.mark.parametrize(("query", "limit"), [("", 5), ("  ", 5), ("x", 0), ("x", 101)])
def test_bad_queries(desk, query, limit):
    with pytest.raises(QueryError) as error:
        desk.search(query, limit=limit)
    assert error.value.code == "invalid_query"


def test_unknown_database(desk):
    with pytest.raises(QueryError) as error:
        desk.search("x", databases=["alpha", "nope"])
    assert error.value.code == "unknown_database"
    assert desk.search("data protection", databases='["zeta"]').data.count() == 3
    assert desk.search("data protection", databases=[]).data.count() == 4


def test_first_per_group_beyond_the_planned_limit(spark):
    df = spark.range(9000).select("id", (F.col("id") % 2).alias("k"))
    for n in (5, 1500):
        got = merge.first_per_group(df, ["k"], [F.col("id").desc()], n).collect()
        assert sorted(r["id"] for r in got) == list(range(9000 - 2 * n, 9000))


@pytest.mark.parametrize("broadcast", [None, False])
def test_many_phrases_against_brute_force(spark, broadcast):
    rng = random.Random(11)
    words = ["of", "the", "a", "Été", "data", "law", "x1"]
    lines = [", ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(120)]
    phrases = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)]
    phrases += [lines[3], lines[7].upper(), "—", "", "of the of the of the of the of the"]
    table = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    queries = spark.createDataFrame(list(enumerate(phrases)), "query_id int, phrase string")
    rows = postings.texts(table, "db.t", ["id"], ["text"])
    got = {
        (r["query_id"], int(r["row_key"]))
        for r in postings.match_phrases(rows, queries, broadcast).collect()
    }
    spaced = [f" {' '.join(phrase_tokens(line))} " for line in lines]
    expected = {
        (q, i)
        for q, phrase in enumerate(phrases)
        if phrase_tokens(phrase)
        for i, line in enumerate(spaced)
        if f" {' '.join(phrase_tokens(phrase))} " in line
    }
    assert got == expected


def test_only_hits_leave_their_texts(spark, monkeypatch):
    """Short blocks, several passes, phrases over block ends; what a join gets are the hits themselves."""
    monkeypatch.setattr(postings, "_BLOCK", 16)
    monkeypatch.setattr(postings, "PHRASES_AT_ONCE", 7)
    made, checkpoint = [], type(spark.range(1)).checkpoint

    def counted(self, *args):
        made.append(checkpoint(self, *args))
        return made[-1]

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", counted)
    lines = [" ".join(f"w{(i * k) % 31}" for k in range(60)) for i in range(200)]
    phrases = [" ".join(f"w{(3 * k + a) % 31}" for k in range(n)) for a in range(8) for n in (2, 9, 30)]
    table = spark.createDataFrame(list(enumerate(lines)), "id int, text string")
    queries = spark.createDataFrame(list(enumerate(phrases)), "query_id int, phrase string")
    got = postings.match_phrases(postings.texts(table, "t", ["id"], ["text"]), queries, False).collect()
    expected = {(q, i) for q, p in enumerate(phrases) for i, line in enumerate(lines) if f" {p} " in f" {line} "}
    assert {(r["query_id"], int(r["row_key"])) for r in got} == expected and len(got) == len(expected)
    hits = made[-1]
    assert hits.columns == ["table", "row_key", "phrase"] and hits.count() == len(expected)


def test_row_keys_of_several_columns_stay_apart(spark):
    df = spark.createDataFrame(
        [("a/b", "c"), ("a", "b/c"), ("a%2Fb", "c"), (None, "a"), ("a", None)], "k string, l string"
    ).withColumn("text", F.lit("one phrase"))
    rows = postings.texts(df, "t", ["k", "l"], ["text"])
    assert rows.select("row_key").distinct().count() == 5
    queries = spark.createDataFrame([(1, "one phrase")], "query_id int, phrase string")
    assert postings.match_phrases(rows, queries).count() == 5
