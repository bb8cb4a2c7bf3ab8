from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabulary.errors import QueryError
from tabulary.operators import filters
from tabulary.operators.filters import Clause, apply_filters

ROWS = [
    (1, "Decision A", 500, 1.5),
    (2, "decision b", 1000, 2.5),
    (3, "ÉTÉ Decision", 2000, None),
    (4, None, None, 4.0),
    (5, "100% sure_thing", 1000, 0.5),
    (6, "C:\\Ends (a.b)\nK", 70, 0.0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "n int, title string, penalty long, score double")


def ids(df, *clauses):
    return sorted(r["n"] for r in apply_filters(df, clauses).collect())


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        (("title", "exact", "Decision A"), [1]),
        (("title", "not", "Decision A"), [2, 3, 5, 6]),
        (("title", "contains", "DECISION"), [1, 2, 3]),
        (("title", "contains", "été"), []),
        (("title", "contains", "É"), [3]),
        (("title", "contains", "%"), [5]),
        (("title", "contains", "e_t"), [5]),
        (("title", "contains", ""), [1, 2, 3, 5, 6]),
        (("title", "startswith", "Dec"), [1, 2]),
        (("title", "startswith", "dECISION b"), [2]),
        (("title", "startswith", "100"), [5]),
        (("title", "endswith", "A"), [1]),
        (("title", "contains", "\\ENDS"), [6]),
        (("title", "contains", "(A.B)\nk"), [6]),
        (("title", "contains", "a?b"), []),
        (("title", "contains", "\u212a"), []),
        (("title", "endswith", "b)\nK"), [6]),
        (("title", "startswith", "c:\\e"), [6]),
        (("title", "endswith", "a much longer text than any title here"), []),
        (("title", "endswith", "DECISION"), [3]),
        (("penalty", "contains", "00"), [1, 2, 3, 5]),
        (("penalty", "gt", 1000), [3]),
        (("penalty", "gte", "1000"), [2, 3, 5]),
        (("penalty", "lt", 1000), [1, 6]),
        (("penalty", "lte", 1000), [1, 2, 5, 6]),
        (("score", "gte", "2.5"), [2, 4]),
        (("title", "gt", "d"), [2, 3]),
        (("title", "in", ["Decision A", "decision b, too"]), [1]),
        (("title", "in", []), []),
        (("title", "notin", ["Decision A"]), [2, 3, 5, 6]),
        (("title", "notin", []), [1, 2, 3, 5, 6]),
        (("penalty", "in", ["500", 2000.0, "x"]), [1, 3]),
        (("penalty", "exact", "1000.0"), [2, 5]),
        (("penalty", "exact", "many"), []),
        (("penalty", "not", "many"), [1, 2, 3, 5, 6]),
        (("penalty", "isnull", None), [4]),
        (("penalty", "isnull", "ignored"), [4]),
        (("penalty", "notnull", None), [1, 2, 3, 5, 6]),
    ],
)
def test_operators(rows, clause, expected):
    assert ids(rows, Clause(*clause)) == expected


def test_clauses_are_anded_and_may_repeat_a_column(rows):
    assert ids(rows, Clause("penalty", "gte", 600), Clause("penalty", "lt", 1500)) == [2, 5]


@pytest.mark.parametrize("value", [3.99, True, "3.5", "x", [1]])
def test_whole_number_bounds_only(rows, value):
    with pytest.raises(QueryError) as error:
        apply_filters(rows, [Clause("penalty", "gt", value)])
    assert error.value.code == "invalid_filter_op"
    assert "3.99" not in str(error.value)


def test_real_bound_must_be_a_number(rows):
    with pytest.raises(QueryError):
        apply_filters(rows, [Clause("score", "gt", "high")])


@pytest.mark.parametrize("op", ["exact", "contains", "gt", "in"])
def test_value_is_required(rows, op):
    with pytest.raises(QueryError, match="value required"):
        apply_filters(rows, [Clause("title", op)])


@pytest.mark.parametrize("value", ["a,b", [["a"]], [None], {"a": 1}])
def test_membership_needs_a_flat_list(rows, value):
    with pytest.raises(QueryError, match="list of strings"):
        apply_filters(rows, [Clause("title", "in", value)])


def test_unknown_operator_and_fields_are_rejected():
    with pytest.raises(QueryError):
        Clause("title", "like", "x")
    with pytest.raises(QueryError):
        Clause.of({"column": "title", "op": "exact", "value": "x", "title__exact": "y"})
    with pytest.raises(QueryError):
        Clause.of({"column": "title"})


@pytest.mark.parametrize("extra", [0, 2000])
@pytest.mark.parametrize(
    ("dtype", "values", "member", "found"),
    [
        ("float", [0.1, 0.5, None], "0.1", []),
        ("float", [0.1, 0.5, None], "0.5", [1]),
        ("int", [3, -7, None], "3000000000", []),
        ("int", [3, -7, None], "3.0", [0]),
        ("tinyint", [3, -7, None], 300, []),
        ("bigint", [3, 1 << 62, None], str(1 << 70), []),
        ("bigint", [3, 1 << 62, None], str(1 << 62), [1]),
        ("decimal(10,2)", ["0.10", "2.50", None], "2.5", [1]),
        ("decimal(10,2)", ["0.10", "2.50", None], "2.501", []),
        ("string", ["a", "B", None], "B", [1]),
        ("timestamp_ntz", ["2024-01-01 10:00:00", "2024-01-02 00:00:00", None], "2024-01-02", [1]),
        ("date", ["2024-01-01", "2024-01-02", None], "2024-01-02", [1]),
        ("boolean", ["true", "false", None], "0", [1]),
    ],
)
def test_membership_is_alike_for_every_list_length(spark, dtype, values, member, found, extra):
    filler = [f"0.{i}77" if dtype == "float" else "zz" if dtype == "string" else f"{i + 9}.5" for i in range(extra)]
    text = [(i, None if v is None else str(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(text, "n int, t string").select("n", F.col("t").cast(dtype).alias("x"))
    assert ids(df, Clause("x", "in", [member, *filler])) == found
    rest = [i for i, v in enumerate(values) if v is not None and i not in found]
    assert ids(df, Clause("x", "notin", [member, *filler])) == rest


def test_declared_types_decide_how_values_compare(spark):
    df = spark.createDataFrame([(1, "9", 3), (2, "10", 20), (3, "x", None)], "n int, t string, v int")
    declared = {"t": "INTEGER", "v": "TEXT"}

    def found(*clause):
        return sorted(r["n"] for r in apply_filters(df, [Clause(*clause)], declared).collect())

    assert found("t", "gt", "9") == [2]
    assert found("t", "in", ["9.0", 10]) == [1, 2]
    assert found("t", "in", [str(i) for i in range(3000)]) == [1, 2]
    assert found("v", "gt", "3") == []
    assert found("v", "lt", "3") == [2]
    with pytest.raises(QueryError):
        found("t", "gt", "nine")


def test_long_lists_join(rows):
    wanted = [str(i) for i in range(filters.IN_LIST_LIMIT + 500)]
    assert ids(rows, Clause("penalty", "in", wanted)) == [1, 2, 5, 6]
    assert ids(rows, Clause("penalty", "notin", wanted)) == [3]


def test_timestamps_compare_as_iso_text(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 10:00:00'), "
        "(2, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS t(n, at)"
    )
    assert ids(df, Clause("at", "gte", "2024-01-02")) == [2]
    assert ids(df, Clause("at", "exact", "2024-01-01T10:00:00")) == [1]
    with pytest.raises(QueryError):
        ids(df, Clause("at", "lt", "yesterday"))


def test_bare_comparisons_reach_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")

    def pushed(*clause):
        found = apply_filters(orders.select("o_totalprice", "o_orderpriority"), [Clause(*clause)])
        return found._jdf.queryExecution().executedPlan().toString()

    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in pushed("o_totalprice", "gte", 1000)
    bounded = pushed("o_orderpriority", "startswith", "Urgent")
    assert "GreaterThanOrEqual(o_orderpriority,URGENT)" in bounded
    assert "LessThan(o_orderpriority,urgenu)" in bounded
    assert "StringStartsWith(o_orderpriority,1-)" in pushed("o_orderpriority", "startswith", "1-")


def test_prefix_bounds_never_lose_a_row(spark):
    words = ["URGENT", "urgent", "Urgenz", "uRgEnTly", "urgens", "URGENU", "vrgent", "", "Über"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for prefix in ("urgent", "U", "z", "ü", "Übe"):
        folded = F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        plain = folded.startswith(filters.fold_ascii_value(prefix))
        expected = sorted(r["w"] for r in df.filter(plain).collect())
        got = sorted(r["w"] for r in apply_filters(df, [Clause("w", "startswith", prefix)]).collect())
        assert got == expected
