from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabulary.operators import percentiles
from tabulary.operators.percentiles import exact_percentiles, percentile_row

PS = (0.0, 0.01, 0.5, 0.9, 0.95, 0.999)


@pytest.fixture(autouse=True, params=[30, 10_000])
def small(request, monkeypatch):
    """How many values may be sorted: with few of them, several rounds narrow the rest."""
    monkeypatch.setattr(percentiles, "SMALL", request.param)
    return request.param


def expected(values, p):
    return sorted(values)[int(p * len(values))]


@pytest.mark.parametrize("shape", ["uniform", "heavy_tail", "few_values", "one_value", "single"])
def test_matches_sort_and_index(spark, shape):
    rng = random.Random(shape)
    make = {
        "uniform": lambda: [rng.random() for _ in range(5000)],
        "heavy_tail": lambda: [rng.paretovariate(0.5) for _ in range(5000)],
        "few_values": lambda: [float(rng.choice([1, 1, 1, 2, 50])) for _ in range(5000)],
        "one_value": lambda: [3.5] * 777,
        "single": lambda: [1.25],
    }
    values = make[shape]()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["p"]: r["value"] for r in exact_percentiles(df, "v", PS).collect()}
    assert got == {p: expected(values, p) for p in PS}


def test_groups_one_of_them_hot(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.gauss(0, 1)) for _ in range(6000)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {(r["k"], r["p"]): r["value"] for r in exact_percentiles(df, "v", PS, ["k"]).collect()}
    groups: dict = {}
    for k, v in data:
        groups.setdefault(k, []).append(v)
    assert got == {(k, p): expected(vs, p) for k, vs in groups.items() for p in PS}


def test_a_poor_sketch_changes_nothing(spark, monkeypatch, small):
    monkeypatch.setattr(percentiles, "_ACCURACY", 2)
    monkeypatch.setattr(percentiles, "SMALL", max(small, 400))
    values = [float(i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["p"]: r["value"] for r in exact_percentiles(df, "v", (0.5, 0.95)).collect()}
    assert got == {0.5: 500.0, 0.95: 950.0}


def test_only_small_groups_are_sorted(spark, small):
    """The last window sees at most as many values a goal as may be sorted."""
    df = spark.range(60_000).selectExpr("double(id * 7919 % 60000) as v", "id % 3 as k")
    found = exact_percentiles(df, "v", (0.25, 0.75), ["k"])
    groups = {}
    for i in range(60_000):
        groups.setdefault(i % 3, []).append(float(i * 7919 % 60000))
    got = {(r["k"], r["p"]): r["value"] for r in found.collect()}
    assert got == {(k, p): expected(vs, p) for k, vs in groups.items() for p in (0.25, 0.75)}


def test_no_samples_give_zero(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_percentiles(empty, "v", (0.5,)).count() == 0
    assert percentile_row(empty, "v", (0.5, 0.95)).first().asDict() == {"p50": 0.0, "p95": 0.0}


def test_shares_below_one_only(spark):
    with pytest.raises(ValueError):
        exact_percentiles(spark.range(3), "id", (1.0,))


def test_approximate_variant_is_close(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    (row,) = percentiles.approx_percentiles(df, "v", (0.5,)).collect()
    assert abs(row["value"] - 5000) < 10
