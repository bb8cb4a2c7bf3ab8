from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulary.errors import QueryError
from tabulary.operators import paging
from tabulary.operators.numbering import number_rows
from tabulary.operators.paging import SortKey
from tabulary.registry import Registry


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.choice([None, 1, 2, 2, 3]), rng.choice(["a", "b", None])) for i in range(47)]
    return spark.createDataFrame(data, "id int, v int, s string").cache()


def walk(df, keys, size):
    position, pages = None, []
    while True:
        page = paging.page(df, keys, size, position).collect()
        end, more = paging.page_end(df, keys, size, position)
        pages.append([r["id"] for r in page])
        if not more:
            assert end is None
            return pages
        position = end


@pytest.mark.parametrize("sort", [None, "v", "-v", "s", "-s", "id", "-id"])
@pytest.mark.parametrize("size", [10, 47])
def test_pages_add_up_to_the_whole_order(rows, sort, size):
    keys = paging.sort_keys(sort, ["id"])
    whole = [r["id"] for r in rows.orderBy(*paging.order_by(keys)).collect()]
    pages = walk(rows, keys, size)
    assert [i for page in pages for i in page] == whole
    assert all(len(p) == size for p in pages[:-1])


def test_nulls_are_lowest(rows):
    up = paging.page(rows, paging.sort_keys("v", ["id"]), 1).first()
    down = rows.orderBy(*paging.order_by(paging.sort_keys("-v", ["id"]))).collect()[-1]
    assert up["v"] is None and down["v"] is None


@pytest.mark.parametrize("sort", [None, "v", "-s"])
def test_a_late_page_is_the_same_page(rows, sort):
    keys = paging.sort_keys(sort, ["id"])
    position = None
    for _ in range(3):
        early = paging.page(rows, keys, 7, position).collect()
        assert paging.late_page(rows, keys, ["id"], 7, position).collect() == early
        position = tuple(early[-1][k.column] for k in keys)
    none = paging.late_page(rows.filter("id < 0"), keys, ["id"], 7)
    assert none.count() == 0


def test_a_late_page_reads_text_of_its_keys_only(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    keys = paging.sort_keys("-n_chars", ["doc_id"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    late = paging.late_page(documents.select("doc_id", "n_chars", "text"), keys, ["doc_id"], 5)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id," in plan
    assert plan.count("FileScan") == 1


def test_every_row_gets_the_page_a_walk_would_show_it_on(rows):
    keys = paging.sort_keys("-v", ["id"])
    pages = walk(rows, keys, 10)
    numbered = {r["id"]: (r["position"], r["page"]) for r in paging.assign_pages(rows, keys, 10).collect()}
    for number, page in enumerate(pages):
        for place, row in enumerate(page):
            assert numbered[row] == (number * 10 + place + 1, number)


def test_a_page_plans_a_top_n(rows):
    plan = paging.page(rows, paging.sort_keys("v", ["id"]), 5)._jdf.queryExecution()
    assert "TakeOrderedAndProject" in plan.executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 201, -1, True, 1.5, "5"])
def test_limits(limit):
    with pytest.raises(QueryError):
        paging.check_limit(limit, paging.MAX_LIMIT)


def test_a_position_of_another_shape_is_rejected():
    with pytest.raises(QueryError) as error:
        paging.after([SortKey("v"), SortKey("id")], (1,))
    assert error.value.code == "invalid_cursor"


def test_numbering_splits_a_hot_key(spark, many_parts):
    """Nine of ten rows on one key: its positions run over many parts without a gap."""
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), (F.col("id") % 70).cast("string")))
        .otherwise("hot")
        .alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"),
    )
    numbered = number_rows(df, [F.col("v").desc(), F.col("id").asc()], keys=["k"])
    got = {r["id"]: r["position"] for r in numbered.collect()}
    by_key: dict[str, list] = {}
    for r in df.collect():
        by_key.setdefault(r["k"], []).append((-r["v"], r["id"]))
    expected = {
        i: n for rows_ in by_key.values() for n, (_, i) in enumerate(sorted(rows_), start=1)
    }
    assert got == expected
    parts = df.repartitionByRange("k", F.col("v").desc(), "id").filter("k = 'hot'")
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_numbering_keeps_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    got = {r["id"]: r["position"] for r in number_rows(df, [F.col("id").asc()], ["k"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "array<int>"])
def test_numbering_within_keys_of_any_kind(spark, many_parts, kind):
    """Hot, null and NaN keys over many parts."""
    key = {
        "string": "if(id % 3 = 0, 'hot', if(id % 11 = 0, null, concat('k', id % 40)))",
        "double": "if(id % 3 = 0, double('NaN'), if(id % 11 = 0, null, double(id % 40)))",
        "timestamp": "if(id % 3 = 0, timestamp'2026-01-01', if(id % 11 = 0, null, timestamp_seconds(id % 40)))",
        "array<int>": "if(id % 3 = 0, array(1, null), if(id % 11 = 0, null, array(int(id % 40))))",
    }[kind]
    df = spark.range(3000).selectExpr("id", f"{key} as k", "id * 7919 % 3001 as v")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["id"]: r["position"] for r in number_rows(df, [F.col("v").desc()], ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    window = Window.partitionBy("k").orderBy(F.col("v").desc())
    expected = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(window)).collect()}
    assert got == expected


def test_numbering_exchanges_the_rows_once(spark):
    """What is read back is joined with one row per part and never shuffled or windowed again."""
    df = spark.range(1000).selectExpr("id", "id % 5 as k", "repeat('x', 10) as payload")
    numbered = number_rows(df, [F.col("id").asc()], ["k"])
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    rows_side = plan.split("+- ")[0:1] + [line for line in plan.splitlines() if "payload" in line]
    assert not any("Window" in line or "Repartition" in line for line in rows_side)
    physical = numbered._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in physical
    assert not any("payload" in line and ("Exchange" in line or "Sort" in line) for line in physical.splitlines())


SECRET = bytes(range(32))


def _hidden_rows(spark):
    return spark.range(300).selectExpr(
        "id", "id % 3 as v", "timestamp_micros(id * 1234567) as at", "if(id % 5 = 0, null, double(id) / 7) as d"
    )


def test_sealed_positions_walk_all_rows(spark):
    df, seen, position = _hidden_rows(spark), [], None
    keys = paging.sort_keys("-v", ["d", "at", "id"])
    hidden, seal = frozenset({"id", "at", "d"}), paging.Seal(SECRET, "r")
    while True:
        inner = None if position is None else paging.unsealed(df, keys, hidden, seal, position)
        seen += [r["id"] for r in paging.page(df, keys, 70, inner).collect()]
        position, more = paging.sealed_page_end(df, keys, hidden, 70, seal, inner)
        if not more:
            break
        assert len(position) == 2 and isinstance(position[1], str)
    assert seen == [r["id"] for r in df.orderBy(*paging.order_by(keys)).collect()]


def test_no_trial_of_ids_opens_a_seal(spark):
    """Every id closed without the secret, or digested, differs; so do two seals of one row."""
    import base64
    import hashlib
    import json

    df, keys, hidden = spark.range(300).selectExpr("id"), paging.sort_keys(None, ["id"]), frozenset({"id"})
    seal = paging.Seal(SECRET, "r")
    (one,), _ = paging.sealed_page_end(df, keys, hidden, 40, seal)
    (two,), _ = paging.sealed_page_end(df, keys, hidden, 40, seal)
    assert one != two and paging.unsealed(df, keys, hidden, seal, (one,)) == (39,)
    raw = base64.b64decode(one)
    for i in range(300):
        for text in (str(i), json.dumps([str(i)]), json.dumps({"id": i})):
            digest = hashlib.sha256(text.encode())
            assert digest.digest() not in raw and digest.hexdigest() != one
    with pytest.raises(ValueError, match="secret"):
        Registry([], secret=bytes(31))


@pytest.mark.parametrize("change", ["secret", "request", "text", "garbage", "number", "empty", "columns"])
def test_foreign_or_changed_seals_are_refused(spark, change):
    df, keys, hidden = _hidden_rows(spark), paging.sort_keys(None, ["id", "v"]), frozenset({"id", "v"})
    seal = paging.Seal(SECRET, "r")
    (text,), _ = paging.sealed_page_end(df, keys, hidden, 40, seal)
    other = {
        "secret": (paging.Seal(bytes(32), "r"), text),
        "request": (paging.Seal(SECRET, "s"), text),
        "text": (seal, ("B" if text[0] == "A" else "A") + text[1:]),
        "garbage": (seal, "not base64 at all"),
        "number": (seal, 5),
        "empty": (seal, ""),
        "columns": (seal, paging.sealed_page_end(df, keys[:1], hidden, 40, seal)[0][0]),
    }[change]
    with pytest.raises(QueryError) as error:
        paging.unsealed(df, keys, hidden, other[0], (other[1],))
    assert error.value.code == "invalid_cursor"
